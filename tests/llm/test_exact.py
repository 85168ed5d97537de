"""Unlike spans that polynomial hashes modulo 2**64 take as equal: words of the Thue-Morse sequence and their complements."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prismdex.llm import decontaminate, quality_rules, suffix_dedup, textblocks as tb, token_files
from tests.llm.test_corpus import hits_by_hand, quality_by_hand, repeats_by_hand


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


PAIRS = [(head + thue_morse(n), head + thue_morse(n, "b", "a")) for n in (64, 1024, 2048, 4096) for head in ("", "samehead")]


def test_names_and_hashes_tell_them_apart():
    for one, two in PAIRS:
        raw = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
        starts, ends, _ = tb.word_spans(tb.SPACE[raw], np.array([0, len(raw)]))
        names, distinct = tb.named(raw, starts, ends)
        assert names.tolist() == [0, 1, 0] and distinct.to_pylist() == [one, two]
        h = tb.span_hashes(raw, starts, ends)
        assert h[0] == h[2] != h[1] and len(set(zip(*(x.tolist() for x in tb.digests(raw, starts, ends)), strict=True))) == 2


def test_hashes_follow_the_bytes_only():
    rng = random.Random(4)
    words = ["".join(rng.choices("ab\0é", k=rng.randint(0, 40))) for _ in range(3000)]
    raw, starts, ends = tb.bytes_of(pa.array(words))
    h = tb.span_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and len({(x, y) for x, y in zip(words, h.tolist(), strict=True)}) == len(set(words))
    at = tb.span_hashes(np.concatenate([np.zeros(3, np.uint8), raw]), starts + 3, ends + 3)
    assert (at == h).all()


def test_quality(spark):
    rows = [(i, f"{a}\n{b}\n{a}" if i % 2 else f"{a}\n{b}") for i, (a, b) in enumerate(PAIRS)] + [(99, " ".join(f"{a} x {b} y" for a, b in PAIRS) * 2)]
    got = {r.doc_id: r.quality for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == quality_by_hand(text)


def top_by_hand(words, sizes):
    total, most = max(1, sum(map(len, words))), 0.0
    for n in sizes:
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        most = max([most, *(c * sum(map(len, g)) / total for g, c in seen.items() if c > 1)])
    return most


def test_coverage_and_verdict_against_brute_force(monkeypatch):
    rng, rules = random.Random(6), quality_rules.Rules()
    texts = ["\n".join(" ".join(rng.choices("ab cde f é".split(), k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(200)) for _ in range(20)] + ["", "x y z " * 40]

    def check():
        found = [quality_rules.measure(raw, off, rules) for raw, off in tb.blocks(pa.array(texts))]
        q = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        for i, text in enumerate(texts):
            words = text.split()
            total, lines, seen, dup = max(1, sum(map(len, words))), text.split("\n"), set(), 0
            for x in lines:
                dup += sum(map(len, x.split())) if x in seen else 0
                seen.add(x)
            assert q["top_ngram"][i] == pytest.approx(top_by_hand(words, rules.top)) and q["dup_line"][i] == pytest.approx(dup / total)
            failed = dup / total > rules.line or any(top_by_hand(words, [n]) > most for n, most in rules.top.items())
            for n, most in rules.dup.items():
                inside, found = set(), set()
                for k in range(len(words) - n + 1):
                    g = tuple(words[k : k + n])
                    inside |= set(range(k, k + n)) if g in found else set()
                    found.add(g)
                failed |= sum(len(words[k]) for k in inside) / total > most
            assert q["kept"][i] == (not failed and not q["base_failed"][i])

    check()
    monkeypatch.setattr(tb, "mix", lambda x: x & np.uint64(3))  # hashes that collide: the confirmation decides
    check()


def test_token_ids():
    from tokenizers import Tokenizer
    import public_tokenizers

    library, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"{b} {a}\n{b}" if k % 2 else f"{a} {b}" for k, (a, b) in enumerate(PAIRS)]
    for _ in range(2):
        for raw, off in tb.blocks(pa.array(texts)):
            ids, first = encode(raw, off)
            assert [ids[i:j].tolist() for i, j in zip(first[:-1], first[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_not_cut():
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), token_files.Encoder(path)
    assert not encode.cuts
    texts = ["Hello,  World! it's", "", "a\nb c", "éa 1.5"]
    for raw, off in tb.blocks(pa.array(texts)):
        ids, first = encode(raw, off)
        assert [ids[i:j].tolist() for i, j in zip(first[:-1], first[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_benchmark_words(spark):
    items = [(k, a) for k, (a, _) in enumerate(PAIRS)]
    rows = [(k, f"x {b} y") for k, (_, b) in enumerate(PAIRS)] + [(50, f"{PAIRS[1][0]} z")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_index(docs)
    for slop in (0, 2):  # one index, any number of benchmarks
        got = {r.doc_id: (r.n_words, sum(s.b - s.a for s in r.spans), r["items"]) for r in decontaminate.matches(docs, benchmark, slop, index=index).collect()}
        assert got == {i: hits_by_hand(t, items) for i, t in rows}
    other = spark.createDataFrame([(7, "Z")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.matches(docs, other, index=index).collect() if r.spans] == [50]


def test_repeated_pieces(spark):
    rows = [(i, x) for i, x in enumerate(x for pair in PAIRS for x in pair)] + [(90, PAIRS[3][1] + "tail"), (91, thue_morse(130) + thue_morse(130, "b", "a"))]
    got = {r.doc_id: (bytes(r.kept), sum(s.b - s.a for s in r.spans), len(r.spans)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeats_by_hand(rows)
