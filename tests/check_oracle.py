"""Compare registered queries with their SQL: ``python tests/check_oracle.py [folder] [key ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else (value + 0.0,)
    return (value,)


# results whose order is the feature
ORDERED = {"sort_subject_sequence", "limit_heatmap_rows", "limit_preview", "sort_groups_by_size", "topk_by_adjusted_p"}


def _rows(table, ordered: bool = False):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(map(_cell, r)) for r in zip(*columns)]
    return names, rows if ordered else sorted(rows, key=repr)


def compare(spark_df, con, sql: str, ordered: bool = False) -> str:
    """Empty text when equal, else the first difference; ``ordered`` compares row by row as they come."""
    got, want = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    names, rows = _rows(got, ordered)
    want_names, want_rows = _rows(want, ordered)
    if names != want_names:
        return f"columns {names} != {want_names}"
    types = {
        n: (str(got.schema.field(n).type), str(want.schema.field(n).type))
        for n in names
        if str(got.schema.field(n).type) != str(want.schema.field(n).type)
    }
    if len(rows) != len(want_rows):
        return f"rows {len(rows)} != {len(want_rows)}"
    bad = [(a, b) for a, b in zip(rows, want_rows) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]} (types {types})"
    return f"types {types}" if types else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from wardline.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = oracle_connection(folder), entry.oracle_sql(), 0
    for key, query in entry.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            note = compare(df, con, sqls[key], key in ORDERED) if key in sqls else f"rows only: {df.toArrow().num_rows}"
        except Exception as error:  # report and go on
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        ok = not note or note.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.2f}s {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
