"""Collocations, fill-in-middle and line dedup against brute force, on odd input and with small bounds."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tests.llm.test_operators import ODD, SCHEMA, corpus

from citeloom.llm import collocations, fill_in_middle, line_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def mined(rows, least, top):
    """Every rule of the contract, on plain lists."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for size in (1, 2, 3, 4):
                f.update((lang or "und", tuple(w[k : k + size])) for k in range(len(w) - size + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    out = []
    for (lang, w), a in cand.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if any(x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * n >= 80 * a for (x, v), n in cand.items()):
            continue
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], total[lang]))
    ranked, seen = [], Counter()
    for lang, s, a, phrase, l, r, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n, -s))
    return ranked


def phrase_rows():
    r, out = random.Random(8), [(x[1], x[2]) for x in [*ODD, *corpus()]]
    words = "the The of OF straße 日本 a#b x|y no-op".split() + [f"w{k}" for k in range(12)]
    for k in range(260):
        w = [r.choice(words) if r.random() < 0.6 else r.choice(words[:4]) for _ in range(r.randint(0, 40))]
        if k % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = "New  york\tCity hall opens".split(" ")
        out.append(("".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for x in w), r.choice(["en", "en", "de", None])))
    return [*out, out[-1], out[-1], ("same same same same same", "en")]


@pytest.fixture(scope="module")
def phrases(spark):
    return phrase_rows(), spark.createDataFrame([(t, x, 1, "w", 2) for t, x in phrase_rows()], "text string, lang string, n long, word string, rank int").repartition(3).cache()


@pytest.mark.parametrize("bounds", [{}, {"TABLE": 5}, {"TABLE_BYTES": 0}, {"HOT": 20, "BUCKET": 300}, {"HOT": 20, "BUCKET": 100, "TABLE": 9}])
def test_collocations(phrases, monkeypatch, bounds):
    """Alike with a table that holds all frequent words, few or none, and with words dealt over buckets."""
    for k, v in bounds.items():
        monkeypatch.setattr(collocations, k, v)
    rows, docs = phrases
    found = [tuple(r) for r in collocations.collocations(docs, least=12, top=15).collect()]
    expected = mined(rows, 12, 15)
    assert sorted(found) == sorted(expected) and any(r[1] == 15 for r in expected)


def test_collocations_of_nothing(spark, phrases):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0 and collocations.collocations(phrases[1], least=10**6).count() == 0


def test_phrases_hold_their_pivot_once():
    """Every occurrence of a phrase is in one fragment, that of the first of its rarest words."""
    r = np.random.RandomState(3)
    symbol, piece = r.randint(-1, 5, 400), np.cumsum(r.rand(400) < 0.1)
    whole = Counter()
    for i in range(400):
        for size in (2, 3, 4):
            w = symbol[i : i + size]
            if len(w) == size and piece[i] == piece[i + size - 1] and (w >= 0).all():
                whole[tuple(w.tolist())] += 1
    mine, side = Counter(), collocations._SIDE
    for row in collocations._fragments(symbol, piece):
        for a, b in collocations._SPANS:
            w = row[side - a : side + b + 1]
            if (w >= 0).all():
                mine[tuple(w.tolist())] += 1
    assert mine == whole


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mix64", lambda x: x * np.uint64(0))
    rows, n = collocations._combined(np.array([[1, 2], [2, 1], [1, 2], [2, 2], [2, 1]]), np.arange(5))
    assert sorted(zip(map(tuple, rows.tolist()), n.tolist())) == [((1, 2), 2), ((2, 1), 5), ((2, 2), 3)]


# Fill-in-middle -------------------------------------------------------------------------------


def rewritten(text, doc_id):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    i, j = sorted(v % (len(u) + 1) for v in h[:2])
    p, m, s = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    r = random.Random(5)
    odd = ["<P>", "a <M> b", "a<S", "< P>", "<P<S", " x", "x ", " \x0b\x0c", "ü 日本 x y", "\x1c a\x85b"]
    rows = [*[x[:2] for x in ODD], *[x[:2] for x in corpus()], *[(k, r.choice(odd) * r.randint(1, 3)) for k in range(200, 400)], (None, "no id here at all"), (None, None), (12, corpus()[2][1])]
    docs = spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, form string, n long").repartition(3)
    found = fill_in_middle.transform(docs).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(i, *(x := rewritten(t, i))[:4], digest(x[4]), digest(t or ""), x[4]) for i, t in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert {x[2] for x in expected} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0), output=False).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=SPACE + "ab<PSM>é日", max_size=40), st.integers(0, 10**6))
def test_any_text_is_restored(text, doc_id):
    *cut, output = fill_in_middle.rewrite(fill_in_middle.scanner(), text, doc_id, rate=100)
    assert fill_in_middle.restore(output, cut[1]) == text
    assert fill_in_middle.rewrite(fill_in_middle.scanner(), text, doc_id) == rewritten(text, doc_id)


# Line dedup -----------------------------------------------------------------------------------


def kept_lines(rows):
    key = lambda x: x.strip(SPACE).translate(FOLD)
    order = lambda i: (i is None, i or 0)
    held: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest(), "\n".join(left)))
    return out


def line_rows():
    r = random.Random(6)
    pool = ["short", "ten chars!", "nine char", "ÄÖÜäöüßéèê", "Ünïcödé"] + [f"a line that comes back, number {k}" for k in range(30)]
    rows = [x[:2] for x in [*ODD, *corpus()]]
    for k in range(300, 500):
        lines = [r.choice(pool) if r.random() < 0.4 else f"line {k} of {r.random()}" for _ in range(r.randint(0, 12))]
        lines = [r.choice(["", " ", "\t\x0b"]) + (x.upper() if x.isascii() and r.random() < 0.3 else x) + r.choice(["", "\r", "  "]) for x in lines]
        rows.append((k, "\n".join([*lines, "the line that all of them have"] if k % 3 else lines)))
    return [*rows, rows[-1], (499, "the line that all of them have\nanother text of the same id"), (None, "another text of the same id\nonly without an id\n"), (None, "only without an id"), (9, "a text that only one id has"), (9, "a text that only one id has\n\n")]


@pytest.mark.parametrize("bounds", [{}, {"SEGMENT": 50}, {"SEGMENT": 50, "MOST_BITS": 160}, {"BITS": 1, "MOST_BITS": 8}])
def test_line_dedup(spark, monkeypatch, bounds):
    """Alike with many segments, and with second filters so full that they let every line through."""
    for k, v in bounds.items():
        monkeypatch.setattr(line_dedup, k, v)
    rows = line_rows()
    docs = spark.createDataFrame([(*x, b"k", 1, 2) for x in rows], "doc_id long, text string, key binary, id long, n_lines int").repartition(4)
    found = [tuple(r) for r in line_dedup.deduplicate(docs).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, kept_lines(rows)))
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def test_filters_never_miss():
    r = np.random.RandomState(1)
    codes = r.randint(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32)
    some = line_dedup.Bloom(16 * 3000)
    some.add(codes)
    assert some.has(codes).all() and some.has(r.randint(0, 2**32, 20_000, dtype=np.uint64).astype(np.uint32)).mean() < 0.05


def test_few_lines_are_suspected(spark):
    """Of 20,000 lines and 100 that stand twice, hardly more than the latter are shuffled."""
    docs = spark.range(200).selectExpr("id as doc_id", "array_join(transform(sequence(1, 100), k -> concat('line ', id, ' number ', k, ' here')), '\\n') || '\\nthe pair of ' || (id div 2) as text")
    n = docs.sparkSession.sparkContext.accumulator(0)
    spied = line_dedup.written

    def counting(df):
        out = spied(df)
        n.add(out.count())
        return out

    line_dedup.written = counting
    try:
        out = line_dedup.deduplicate(docs).agg({"n_dropped": "sum"}).first()[0]
    finally:
        line_dedup.written = spied
    assert out == 100 and 200 <= n.value < 600
