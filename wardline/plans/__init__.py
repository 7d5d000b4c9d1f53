"""Building blocks that keep joins and ordered windows balanced, and the end-to-end cohort plan."""
