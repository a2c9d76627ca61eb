"""Prompts with the whole text, and names by the rules of create_entry_point."""

from coppice.operators import reports

CASES = [
    ("Sort the list of numbers by their size and return a new list", "sort_the_list"),
    ("Add 3 to x", "f_add"),
    ("of a in the", "of_a"),
    ("Read `path` now", "f_read"),
    ("Get x, y!", "get_x_y"),
    ("1e3 things", "f"),
    ("¿cómo se hace", "cómo_se_hace"),
    ("", "f"),
    (None, "f"),
]


def test_prompt_is_whole(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.entry, r.prompt) for r in reports.prompt_render(spark, str(tmp_path)).collect()}
    assert got == {k: (n, f'def {n}():\n    \"\"\"{t or ""}\"\"\"\n') for k, (t, n) in enumerate(CASES)}
