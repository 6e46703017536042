import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chunking as C
from tidemark.llm import truncation as X


# ---- chunking -------------------------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.text("ab .,\n\r\t#-é́漢", max_size=300), st.one_of(st.none(), st.integers(1, 60)), st.one_of(st.none(), st.integers(0, 70)))
def test_pieces_join_to_the_text(text, size, overlap):
    cut = C.pieces(text, size, overlap)
    s = C.DEFAULT_SIZE if size is None else size
    assert "".join(text[a + c : b] for a, b, c in cut) == text.strip(C.BLANKS)
    assert all(0 < b - a <= s and c < b - a for a, b, c in cut)
    assert (len(cut) > 1) == (len(text.strip(C.BLANKS)) > s)
    assert all(q[0] + q[2] == p[1] for p, q in zip(cut, cut[1:]))


def test_cuts_where_the_text_pauses():
    text = "First sentence here. Second one is longer, with a clause.\n\nA new paragraph starts and goes on for a while."
    assert [text[a:b] for a, b, _ in C.pieces(text, 62, 0)][0].endswith("\n\n")
    assert [b - a for a, b, _ in C.pieces("x" * 25, 10, 4)] == [10, 10, 10, 7]
    assert C.pieces(None, 10, 2) == C.pieces(" \n ", 10, 2) == []


def test_cuts_before_a_long_word_rather_than_in_it():
    text = "Intro here. See " + "x" * 40
    assert [text[a:b] for a, b, _ in C.pieces(text, 35, 0)] == ["Intro here. ", "See ", "x" * 35, "xxxxx"]
    assert [text[a:b] for a, b, _ in C.pieces(text, 35, 14)][0] == "Intro here. See "


@pytest.mark.parametrize("block", [1, 4, 16, 1 << 16])
@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(-1, 7), min_size=1, max_size=80), data=st.data())
def test_range_maximum(block, values, data):
    import numpy as np

    was, C.BLOCK = C.BLOCK, block
    try:
        t = C.RangeMaximum(np.array(values, np.int8))
        for _ in range(4):
            lo = data.draw(st.integers(0, len(values) - 1))
            hi = data.draw(st.integers(lo, len(values) - 1))
            best = max(values[lo : hi + 1])
            assert t.argmax(lo, hi) == max(i for i in range(lo, hi + 1) if values[i] == best)
    finally:
        C.BLOCK = was


def test_a_very_long_text_takes_memory_in_proportion():
    import tracemalloc

    text = "A word and another, then a sentence ends here. " * 60_000
    tracemalloc.start()
    cut = C.pieces(text, 900, 120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000 and "".join(text[a + c : b] for a, b, c in cut) == text.strip(C.BLANKS)


def test_split_table(spark):
    df = spark.createDataFrame([("1", "word " * 50, 40, 5), ("2", None, None, None), ("3", "short", None, None), ("3", "short", None, None)], "id string, text string, chunk_size int, overlap int")
    out = C.split_texts(df).collect()
    assert {r.id for r in out} == {"1", "3"} and sum(r.id == "3" for r in out) == 2 and max(r.length for r in out if r.id == "1") <= 40


# ---- truncation -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ['git commit -m "half', "echo $(date", "make x ||", "ls |", "cat a \\", "for f in *; do echo $f", "rg 'a|b", "python - <<'PY' print(1)", "ruff check src --output-form", "ls 2>"])
def test_open_commands(text):
    assert X.analyse(text, True)[0] == "cut"


@pytest.mark.parametrize("text", ['git commit -m "don\'t"', "echo $(date)", "for f in *; do echo $f; done", "python - <<'PY' print(1) PY", "awk '{print $1}'"])
def test_closed_commands(text):
    assert X.analyse(text, True)[0] != "cut"


@pytest.mark.parametrize("text, verdict", [
    ("Look at this [truncated]", "cut"), ("Half a lett�", "cut"), ("See:\n```python\ndef f(", "cut"), ("See:\n```\nok\n```", "whole"), ("All done.", "whole"), ("Is it?", "whole"), ("list of (a, b", "cut"), ("first,", "cut"), ("no end", "ask"), ("trailing dots...", "ask"),
])
def test_prompts(text, verdict):
    assert X.analyse(text, False)[0] == verdict


@pytest.mark.parametrize("text, verdict", [("Call run(a,\n\nthen go on.", "cut"), ("Take {\n\n  a: 1\n}.", "whole"), ('A 5" disk.\n\nAll done.', "whole")])
def test_brackets_go_on_over_blank_lines(text, verdict):
    assert X.analyse(text, False)[0] == verdict


def test_blank_texts_are_no_case():
    assert X.analyse(None, False) is None and X.analyse("  ", True) is None


def test_the_baseline_judges_what_structure_cannot(spark):
    whole = [f"Please move the {a} and run the {b} tests." for a in ("cache", "queue", "index", "store") for b in ("unit", "spool", "sync")]
    texts = whole + ["Please move the cache and run the unit tests", "Please move the cache and run the", "Please move the cache and run the uni", "Please move the ca", "Please move the cache and run the unit tests..."]
    df = spark.createDataFrame([("f", str(i), 0, "s", t) for i, t in enumerate(texts)] + [("f", "n", 0, "s", None)], "field_name string, rec_id string, item_no bigint, source string, text string")
    cut = {int(r.rec_id) for r in X.judge(df, False).where("cut").collect()}
    assert cut == {13, 14, 15}
    assert X.judge(df.limit(0), False).count() == 0


def test_the_baseline_asks_the_source_first_and_then_all(spark):
    """A source ends its texts with a tail that goes on in another; texts of a source without any word of it back off."""
    rows = [("a", f"Note {i} says: use the cache.") for i in "bcdefgh"] + [("b", f"Note {i} says: use the cache before noon.") for i in "ijklmnopqr"] + [("a", "Note x says: use the cache"), ("c", "Note y says: use the cache"), ("c", "Note z says: use the cache before")]
    df = spark.createDataFrame([("f", str(i), 0, s, t) for i, (s, t) in enumerate(rows)], "field_name string, rec_id string, item_no bigint, source string, text string")
    once = {int(r.rec_id) for r in X.judge(df, False).where("cut").collect()}
    assert once == {len(rows) - 1}
    many = df.unionByName(df.withColumn("rec_id", F.concat(F.lit("9"), "rec_id"))).unionByName(df.withColumn("rec_id", F.concat(F.lit("8"), "rec_id")))
    assert {int(r.rec_id) for r in X.judge(many, False).where("cut").collect()} & set(range(len(rows))) == once


def test_cut_texts_with_dots_are_no_ends_of_their_tails(spark):
    """In a large table every tail has some that end in dots; neither they nor a lone run of letters make others whole."""
    rows = [f"Compare app/{a}.py with core/{b}.py and list what differs." for a in ("cache", "queue", "index") for b in ("spool", "sync", "store")] * 20
    rows += ["Compare app/cache.py with core/spo...", "Grace is too long, make it configurable.", "Note: spo is short."] + ["Make it configur..."] * 3 + ["Make it configurable."] * 200
    rows += ["Compare app/queue.py with core/spo", "Make it configur", "Compare app/queue.py with core/spool.py and list what differs"]
    df = spark.createDataFrame([("f", str(i), 0, "s", t) for i, t in enumerate(rows)], "field_name string, rec_id string, item_no bigint, source string, text string")
    cut = {int(r.rec_id) for r in X.judge(df, False).where("cut").collect()}
    assert {len(rows) - 3, len(rows) - 2} <= cut and len(rows) - 1 not in cut


def test_an_ending_of_paths_stays_whole_however_many_there_are(spark):
    rows = ["sha256sum dist/bundle.tar.gz"] * 600 + ["echo gzip now"] * 10
    df = spark.createDataFrame([("f", str(i), 0, "s", t) for i, t in enumerate(rows)], "field_name string, rec_id string, item_no bigint, source string, text string")
    assert X.judge(df, True).where("cut").count() == 0


def test_found_names_every_stored_copy(spark, data):
    found = [tuple(r) for r in X.p4_found(spark, data).collect()]
    assert len(found) == len(set(found))
    prompts = {str(r.upsert_id): r.last_prompt for r in spark.read.parquet(f"{data}/session_upserts.parquet").collect()}
    assert all(not re.search(r"[a-z]\.$", prompts[i]) for f, i, _ in found if f == "last_prompt")
