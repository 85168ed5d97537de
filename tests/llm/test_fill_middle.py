"""Fill-in-the-middle against a plain version, exact round trips, and units against regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from prismdex.llm import fill_middle as fm

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "a", "ab", "one two, three.", "x" * 5000, "<P>", "has <S> inside", "a<M", "<", "<<P", "P>", "日本語 テキスト nbsp\r\nnext\fpage", "é é", "\U0001f600" * 9, "\n\n", "  lead and trail \n", "line\nline\n\nlast", "tab\tvt\v" * 300, "<|end|>", "a\x00b"]


def rows():
    rng = random.Random(2)
    more = ["".join(rng.choice("ab é,<>PSM\n\t語.") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return [*enumerate([*TEXTS, *more]), (None, "null id here"), (None, None), (3, "ab"), (3, "ab")]


def by_hand(doc_id, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plain = form == "plain"
    return doc_id, len(t), form, None if plain else a, None if plain else b - a, sha(out), sha(t)


def test_query_against_a_plain_version(spark, tmp_path):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({"fim": F.lit(1), "n": F.lit("x"), "form": F.lit(2), "a.b": F.lit(3), "output": F.lit("o")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = fm.op12_fill_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((by_hand(*x) for x in rows()), key=key)
    assert len({x.form for x in got.collect()}) == 3
    kept = fm.fill_in_middle(frame)
    assert kept.columns == frame.columns and kept.select("fim.output").count() == frame.count() and [x[0] for x in kept.select("`a.b`").distinct().collect()] == [3]
    assert fm.fill_in_middle(frame.limit(0)).collect() == []


def units_by_hand(text, unit):
    """Ends of units."""
    if unit == "point":
        return list(range(1, len(text) + 1))
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]" if unit == "word" else r"[^\n]*\n|[^\n]+$"
    return [m.end() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("unit", ["point", "word", "line"])
def test_units_and_their_places(unit):
    for _, text in rows():
        units = fm.events(unit, fm.SENTINELS).scan(text or "")
        ends = units_by_hand(text or "", unit)
        assert units.n == len(ends) and units.place(0) == 0 and units.place(units.n) == len(text or "") * (units.n > 0)
        assert [units.place(k) for k in range(1, units.n)] == ends[:-1]
        assert units.sentinels == bool(re.search("<[PSM]>", text or ""))


@pytest.mark.parametrize("unit", ["word", "line"])
def test_round_trip_of_other_units(spark, unit):
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows())], SCHEMA)
    sentinels = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    done = fm.fill_in_middle(frame, unit, seed="s", plain_percent=0, spm_percent=50, sentinels=sentinels)
    back = done.select("text", "fim.*", fm.restored(F.col("fim.output"), F.col("fim.form"), sentinels).alias("back")).collect()
    assert all(x.back == (x.text or "") for x in back) and {x.form for x in back} == {"plain", "psm", "spm"}
    assert all((x.form == "plain") == (not x.text) for x in back)


def test_sentinels_that_cannot_be_told_apart():
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "b", "c"), ("a", "a", "b")):
        with pytest.raises(ValueError, match="told apart"):
            fm.check(bad)
    with pytest.raises(ValueError, match="unit"):
        fm.Events("page", fm.SENTINELS)
