"""WARC salvage, main text, chat formatting, token rollups and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import random
import re
from html import unescape

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wardline.llm import chat, html_text, queries, rollups, warc
from wardline.llm.bpe import public_path
from wardline.session import new_path

from .test_pairs_and_leaks import brute_groups
from .test_texts_and_rules import EXTRA_SCHEMA, ODD, extra_rows, plain_rules

F = chat.F


def members():
    bodies = [f"<p>page {i}</p>".encode() * 20 for i in range(6)]
    return bodies, [warc.record_bytes("response", f"{warc.PAGE_URN}{i}", "http://x/\r\nInjected: 1", b, len(b), hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)]


def recovered(data):
    found = list(warc.salvage(data))
    covered = sorted({(o, n) for _, o, n, _, _ in found})
    assert sum(n for _, n in covered) == len(data) and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:], strict=False))
    return [f["payload"] for kind, _, _, _, f in found if kind == "record"], [(o, n, why) for kind, o, n, why, _ in found if kind == "gap"]


def test_undamaged_archives_have_no_gaps():
    bodies, own = members()
    assert recovered(b"".join(own)) == (bodies, [])
    assert recovered(b"") == ([], [])


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "truncated", "head"])
def test_later_records_are_recovered_and_the_gap_is_logged(damage):
    bodies, own = members()
    start, data = len(own[0]), bytearray(b"".join(own))
    if damage == "flip":
        data[start + len(own[1]) // 2] ^= 0xFF
        expected = bodies[:1] + bodies[2:]
    elif damage == "cut":
        del data[start + 30 : start + 60]
        expected = bodies[:1] + bodies[2:]
    elif damage == "junk":
        data[start:start] = b"\x1f\x8b\x08 not a member WARC/1.1\r\n"
        expected = bodies
    elif damage == "head":
        data = data[10:]
        expected = bodies[1:]
    else:
        data = data[:-15]
        expected = bodies[:-1]
    payloads, gaps = recovered(bytes(data))
    assert payloads == expected and len(gaps) == 1 and gaps[0][2]


def test_plain_records_and_wrong_digests():
    body = b"x" * 200
    plain = lambda payload, digest: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (digest, len(payload), payload)
    right, wrong = plain(body, hashlib.sha256(body).hexdigest().encode()), plain(body, b"0" * 64)
    payloads, gaps = recovered(right + wrong + right)
    assert payloads == [body, body] and gaps == [(len(right), len(wrong), "payload digest differs")]


def test_pages_come_back_whole(spark):
    rows = [(5, "u", "z" * 300), (2, None, "z" * 300), (9, "", "z" * 300), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", "z" * 300), (7, "u", "é" * 60), (8, "u", "é" * 60), (2, "u", "z" * 300)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    found = warc.page_records(warc.read_archives(warc.write_archives(warc.mark_revisits(pages), archive_bytes=500))).collect()
    firsts = {"z" * 300: 2, "é" * 60: 7}
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(html)
        again = first is not None and i != first
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=key) == sorted(expected, key=key)
    assert warc.write_archives(warc.mark_revisits(pages.limit(0))).count() == 0


def test_main_text_equals_the_article(spark, folder):
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", article))
        assert html_text.main_text(r["html"]) == " ".join(unescape(plain).split())


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<div class="wrap sidebar-left"><nav>menu</nav><main><article><header><h1>Title &amp; more</h1></header><section><p>First para<b>graph</b> of text that is long
enough.<p>Second   one here, with <a href=x>a link</a>.</section><section><h2>Part</h2><p>Third text in another section, quite long as well.</p>
<ul><li>one<li>two</ul></section><footer>by me</footer></article><section class="comments"><article class="comment"><p>Great post, I love every word!</p>
</article></section></main><aside>Related stuff</aside></div><form><input>Subscribe</form><footer>&copy; x</footer><script>if (a<b) {}</script></body></html>"""


@pytest.mark.parametrize("html,text", [
    (PAGE, "Title & more First paragraph of text that is long enough. Second one here, with a link. Part Third text in another section, quite long as well. one two"),
    ("<div><p>plain page with a long paragraph</p><p>and another one</p></div><ul class=menu><li><a href=1>x</a></ul>", "plain page with a long paragraph and another one"),
    ("just text", "just text"), ("<p>a<p>b", "a b"), ("", ""), ("<nav>only</nav>", ""), ("<b><i>x</b></i> < 3", "x < 3"), ("<!-- never closed <p>x", ""), ("<p " * 9_000, "<p " * 8_999 + "<p"),
])
def test_main_text_of_other_pages(html, text):
    assert html_text.main_text(html) == text


def test_extract_keeps_rows_and_replaces_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "u", None, "old", 3), (1, "u", "<p>x</p>", "old", 3)], "page_id long, url string, html string, text string, `n.x` int")
    assert sorted((r["text"], r["n_chars"], r["n.x"]) for r in html_text.extract(frame).collect()) == [("", 0, 3), ("x", 1, 3)]
    assert html_text.extract(frame.limit(0)).count() == 0


RECORDS = [
    ('{"messages":[{"role":"u","content":"x"}]}', "messages", [("u", "x")]), ('{"messages":[]}', "messages_empty", []),
    ('{"response":null,"prompt":"a"}', "prompt", [("user", "a"), ("assistant", "")]),
    ('{"data":{"question":{"text":"1"},"answer":{"text":2.5}}}', "nested", [("user", "1"), ("assistant", "2.5")]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt"}]}', "sharegpt", [("user", "a"), ("assistant", "")]),
    ('{"instruction":"x","input":"y","output":"z"}', "instruction_input", [("user", "x\n\ny"), ("assistant", "z")]),
    ('{"instruction":"x","input":"","output":"z"}', "instruction_input", [("user", "x"), ("assistant", "z")]),
    ("not json", None, None), (None, None, None), ("{}", None, None), ('{"other":1}', None, None), ("[1]", None, None),
]


def test_fingerprints_select_layouts(spark):
    frame = spark.createDataFrame([(i, r[0], "old") for i, r in enumerate(RECORDS)], "id int, record string, layout string")
    for r in chat.canonical_turns(frame).collect():
        _, layout, turns = RECORDS[r["id"]]
        assert (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]] or r["turns"]) == (layout, turns)


CONTROL = ["</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>", "\\", "\\<|im_end|>", "a\\\nb", "<<s>", "<<SYS>>x<</SYS>>", "", "é👍<|im_end", "|>", "<\\|im_end|>"]


def test_templates_are_read_back_exactly(spark):
    turns = [("user", a) for a in CONTROL] + [("assistant", b) for b in CONTROL] + [("odd<|im_sep|>\nrole", "x")]
    frame = spark.createDataFrame([(turns,), ([],), (None,)], "turns array<struct<role:string,text:string>>")
    formatted = chat.format_turns(frame)
    rows = formatted.select("turns", "formatted", chat.read_back(F.col("formatted")).alias("again"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    assert rows[0]["again"] == rows[0]["turns"] and rows[0]["learned"] == "".join(CONTROL)
    assert rows[0]["formatted"].count(chat.END) == len(turns) and "</s>" not in rows[0]["formatted"]
    assert (rows[1]["again"], rows[1]["learned"], rows[1]["formatted"]) == ([], "", "") and rows[2]["formatted"] is None


def test_records_of_odd_turn_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, 0, "tool", "y"), (None, 0, "user", "z"), (3, None, "user", "q"), (3, 0, "assistant", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_turns(chat.as_records(frame)).collect()}
    assert found == {1: [("user", "a"), ("assistant", "")], 2: [("tool", "y"), ("", "x"), ("", "x")], None: [("user", "z")], 3: [("user", "q"), ("assistant", "r")]}
    assert chat.canonical_turns(chat.as_records(frame.limit(0))).count() == 0


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long")


def test_rollups_count_each_batch_once(spark):
    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    first = changes(spark, [("insert", "a", "en", "t", None, 5), ("insert", "a", "en", "t", None, 7), ("insert", None, "en", "t", None, 1)])
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert rollup.commit("two", changes(spark, [("revise", "a", "en", "t", 5, 9), ("delete", None, "en", "t", 1, None), ("delete", "a", "en", "t", 7, 0)]))
    assert rollup.commit("three", first.limit(0))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 9)]
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("four", changes(spark, [("upsert", "a", "en", "t", 1, 1)]))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 9)]
    assert rollup.commit("four", changes(spark, [("insert", "a", "en", "t", 0, 1)]))  # the failed attempt left nothing that counts
    with pytest.raises(ValueError):
        rollup.commit("../x", first)


def test_token_counts_of_odd_texts(spark):
    frame = spark.createDataFrame(extra_rows(), EXTRA_SCHEMA).select("doc_id", "text")
    reference = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    for r in rollups.bpe_counts(frame).select("text", "n_tokens", rollups.word_count(F.col("text")).alias("words"), rollups.byte_count(F.col("text")).alias("bytes")).collect():
        text = r["text"] or ""
        assert (r["n_tokens"], r["words"], r["bytes"]) == (len(reference.encode(text, add_special_tokens=False).ids), len(re.findall(r"[^\x20\x09-\x0D]+", text)), len(text.encode()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, folder, name):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    expected = connection.execute(queries.SQL[name])
    names = sorted(c[0] for c in expected.description)
    place = [[c[0] for c in expected.description].index(n) for n in names]
    rows = sorted(json.dumps([r[i] for i in place]) for r in expected.fetchall())
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.columns) == names
    assert sorted(json.dumps([r[n] for n in names]) for r in found.collect()) == rows


def test_pipeline_stages_equal_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("predicted", F.lit(7))
    functions = dict(corpus_pipeline.STAGES)
    clean = functions["toxicity"](spark, docs, folder)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and clean.where("predicted <> 7").count() == 0
    assert len(kept & toxic) <= 0.2 * len(toxic) and len(kept) >= 0.8 * docs.count()
    ruled = functions["quality_rules"](spark, docs, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in ruled} <= {i for i, t in texts.items() if not plain_rules(t)[-1]} and len(ruled) > 0.8 * sum(not plain_rules(t)[-1] for t in texts.values())
    unique = functions["ngram_jaccard_join"](spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in unique) == sorted({g[0] for g in brute_groups(texts.items()).values()})
    leaked = {r["doc_id"] for r in queries.QUERIES["op9_decontamination"](spark, folder).collect()}
    assert {r["doc_id"] for r in functions["decontamination"](spark, docs, folder).collect()} == set(texts) - leaked
    pieces = functions["packing"](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == set(texts)


def test_stages_accept_odd_and_no_rows(spark, folder):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES[1:]:
        function(spark, docs, folder).collect()
        assert function(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), folder).count() == 0


def one_member(n=6, bad=None, digest=None):
    """An archive of one gzip member of ``n`` records, one of which may have a wrong payload."""
    plain = []
    for i in range(n):
        payload = f"<p>page {i}</p>".encode() * 50
        record = gzip.decompress(warc.record_bytes("response", f"urn:x-page:{i}", None, payload, len(payload), hashlib.sha256(payload).hexdigest(), None))
        if digest:
            record = record.replace(b"sha256:" + hashlib.sha256(payload).hexdigest().encode(), b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest()))
        plain.append(record.replace(f"page {i}".encode(), b"page x") if i == bad else record)
    return plain


def found_ids(data):
    return [f["record_id"] for kind, *_, f in warc.salvage(data) if kind == "record"], [r for kind, _, _, r, _ in warc.salvage(data) if kind == "gap"]


@pytest.mark.parametrize("digest", [None, "sha1"])
def test_records_around_a_bad_one_in_a_member_stay(digest):
    plain = one_member(bad=2, digest=digest)
    for data in (gzip.compress(b"".join(plain)), b"".join(plain)):
        ids, gaps = found_ids(data)
        assert ids == [f"urn:x-page:{i}" for i in (0, 1, 3, 4, 5)] and len(gaps) == 1 and gaps[0].startswith("payload digest differs")


def test_the_beginning_of_a_broken_member_stays():
    plain, rng = one_member(40), random.Random(3)
    plain = [p + gzip.decompress(warc.record_bytes("response", "urn:x-noise", None, b, len(b), hashlib.sha256(b).hexdigest(), None)) for p in plain for b in [rng.randbytes(3_000)]]
    data = gzip.compress(b"".join(plain))
    for damaged in (data[: len(data) // 2], data[: len(data) // 2] + b"\xff" * 200 + data[len(data) // 2 + 200 :], data[:-8] + b"\0" * 8):
        ids, gaps = found_ids(damaged)
        assert ids[:30] == [x for i in range(15) for x in (f"urn:x-page:{i}", "urn:x-noise")] and gaps


@pytest.mark.parametrize("name", ["right-sidebar", "no-sidebar", "with-footer", "page-header-visible", "discussion"])
def test_names_do_not_remove_most_of_a_page(name):
    lines = [f"Sentence number {i} of the page says something of its own, and goes on for a while." for i in range(8)]
    menu = '<div class="menu"><a href="/a">Home</a> <a href="/b">News</a></div>'
    html = f'<body>{menu}<div id="page" class="{name}">' + "".join(f"<p>{x}</p>" for x in lines) + "</div></body>"
    assert html_text.main_text(html) == " ".join(lines)


def test_a_conversation_that_cannot_be_read_raises(spark, tmp_path):
    rows = spark.range(2).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "repeat('x', CASE WHEN id = 1 THEN 20000001 ELSE 5 END) AS text")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    rows.where("conv_id = 0").write.parquet(str(tmp_path / "short" / "conversations.parquet"))
    assert queries.op8(spark, str(tmp_path / "short")).count() == 2
    with pytest.raises(Exception, match="record not read, conversation 1"):
        queries.op8(spark, str(tmp_path)).collect()


def test_records_without_digest_in_a_broken_member_come_back_unverified():
    bodies = [b"%03d " % i * 400 for i in range(60)]
    plain = lambda kind, body: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    inner = b"".join(plain(b"warcinfo" if i % 3 == 0 else b"response", body) for i, body in enumerate(bodies))
    data = bytearray(gzip.compress(inner))
    whole = [f for kind, *_, f in warc.salvage(bytes(data)) if kind == "record"]
    assert len(whole) == 60 and all(f["verified"] for f in whole)
    data[-6] ^= 1  # the checksum
    found = list(warc.salvage(bytes(data)))
    records = [f for kind, *_, f in found if kind == "record"]
    assert len(records) == 60 and not any(f["verified"] for f in records)
    assert [f["payload"] for f in records if f["record_type"] == "response"] == [b for i, b in enumerate(bodies) if i % 3]
    assert any(kind == "gap" for kind, *_ in found)
