"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd input:
nulls in any column, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from citeloom.llm import byte_bpe, decontaminate, fm_index, importance_sampling, language_id, ngram_join, pii, quality_rules, secrets, substring_dedup, toxicity
from citeloom.llm.common import chained, hash_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \t\n", "en", None, 3), (3, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "Ünï 日本 🎉 x", "de", "s", 9),
    (6, "word " * 30_000, "en", "s", 150_000), (7, "a" * 60_000, "en", "s", 60_000), (8, "1" * 60_000 + ".", None, "s", 60_001), (9, "+ @ . 1.2.3 = : AKIA", "en", "s", 20),
]


def sentences(seed: int, n: int, letters: str) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def corpus() -> list[tuple]:
    r, out = random.Random(4), []
    for k in range(10, 60):
        lang, letters = [("en", "abcdefgh"), ("de", "klmnopäö"), ("fr", "éqrstuvw")][k % 3]
        out.append((k, sentences(k, r.randint(20, 120), letters), lang, "src0" if k % 3 else "src1", None))
    passage = sentences(1000, 60, "abcdefgh")
    for k in range(60, 90):  # copies, near copies and a shared passage
        words = out[k % 7][1].split()
        if k % 3 == 1:
            words[r.randrange(len(words))] = "changed"
        if k % 3 == 2:
            words = [*sentences(k, 30, "abcdxyz").split(), *passage.split(), *sentences(k + 500, 9, "abcdxyz").split()]
        out.append((k, ("\n" if k % 2 else " ").join(words), out[k % 7][2], "src0", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ODD, *corpus()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in [*ODD, *corpus()]}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(spark, docs, empty):
    model = language_id.fit(docs.where("doc_id % 4 <> 2"))
    rows = docs.where("doc_id % 4 = 2 and doc_id between 10 and 59").collect()  # later ones mix languages
    out = by_id(language_id.predict(docs.withColumnRenamed("source", "score"), model))
    assert all(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows)
    assert [(out[k]["lang_pred"], out[k]["score"]) for k in (0, 1, 2, 8)] == [("und", 0.0)] * 4
    assert out[3]["lang_pred"] == out[4]["lang_pred"] and all(0 <= r["score"] <= 1 for r in out.values())
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"} and language_id.predict(empty, model).count() == 0


def test_language_scores_by_brute_force(docs, texts):
    model = language_id.fit(docs)
    out = by_id(language_id.predict(docs, model))

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 18

    for k, t in list(texts.items())[:25]:
        if not t or len(t) > 20_000 or not any(map(str.isalpha, t)):
            continue
        padded, s = f" {t.lower()} ", model.log_prior.astype(float).copy()
        for n in language_id.ORDERS:
            for i in range(len(padded) - n + 1):
                s += model.log_prob[bucket(padded[i : i + n])]
        assert out[k]["lang_pred"] == model.languages[int(s.argmax())] and math.isclose(out[k]["score"], 1 / np.exp(s - s.max()).sum(), rel_tol=1e-6)


@pytest.mark.parametrize("pattern", [r"\p{L}+|\P{L}+", r"\S+|\s+", r"[^\n]+\n?|\n"])
def test_byte_bpe_of_another_pattern(texts, pattern):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    codec = byte_bpe.codec(path, pattern)
    for t in ["", " a  b ", "one two, three", *[t for t in texts.values() if t and len(t) < 3000][:40]]:
        ids = codec.encode(t)
        assert ids.tolist() == own.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_byte_bpe(docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    names = ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = by_id(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, names))
    for k, t in texts.items():
        want = own.encode_ordinary(t or "")
        assert out[k]["ids"] == want and out[k]["n_tokens"] == len(want) and bytes(out[k]["decoded"]) == (t or "").encode()
        assert out[k]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
    assert byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN, names).count() == 0


def test_byte_bpe_memory():
    """Batches are encoded in small parts, and what a task remembers is bounded and given back."""
    texts = [None, "", *("word " * k for k in (9, 70_000, 30_000, 1, 30_000)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(byte_bpe.parts(batch, 1))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and [p.num_rows for p in parts] == [3, 1, 2, 2]
    assert [p.num_rows for p in byte_bpe.parts(batch.slice(0, 0), 1)] == [0]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    codec = byte_bpe.Codec(byte_bpe.load_ranks(path), public_tokenizers.PATTERN)
    tracemalloc.start()
    for k in range(0, 200_000, 10_000):
        text = " ".join(f"{n}x{n % 97}" for n in range(k, k + 10_000))
        assert codec.encode(text).tolist() == own.encode_ordinary(text)
    held = tracemalloc.get_traced_memory()[0]
    codec.forget()
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 25e6 and left < 2e6
    assert codec.encode("7x7 and more").tolist() == own.encode_ordinary("7x7 and more")


@pytest.mark.parametrize("t", ["", " a", "a ", "a  b", "x \n y", "\n\na b", "don't I'LL", "<|endoftext|>", "a　b \xa0 c", ". a. ,b 's x's,", "\x00\x01 \x1c a"])
def test_byte_bpe_white_space(t):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    assert byte_bpe.codec(path, public_tokenizers.PATTERN).encode(t).tolist() == own.encode_ordinary(t)


def components(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_ngram_join(docs, texts, empty, monkeypatch):
    want = components(texts)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(ngram_join.components(docs)).items()} == want
    for name, value in (("FLUSH", 150), ("TILE", 100), ("ROUNDS", 1), ("PIVOTS", 1)):  # many tiles, direct entries, a rest
        monkeypatch.setattr(ngram_join, name, value)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(ngram_join.components(docs)).items()} == want
    assert ngram_join.components(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 3])
def test_ngram_join_with_a_line_in_all_documents_and_chains(spark, rounds, monkeypatch):
    r = random.Random(9)
    line, base = sentences(1, 20, "abcdefgh"), sentences(2, 45, "abcdefgh").split()
    texts = {k: f"{line}\n{sentences(100 + k, r.randint(5, 40), 'abcdefgh')}" for k in range(60)}
    for k in range(60, 150):  # one changed word each: similar only where the changes are close, the base is not there
        words = list(base)
        words[r.randrange(45)] = f"w{k}"
        texts[k] = line + " " + " ".join(words) if k % 4 == 0 else " ".join(words)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    out = by_id(ngram_join.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)))
    assert {k: (x["n_shingles"], x["component_id"]) for k, x in out.items()} == components(texts)


def test_ngram_join_null_and_repeated_ids(spark):
    t, near, other = (sentences(k, 60, "abcdefgh") for k in (1, 1, 3))
    near = " ".join(near.split()[:-2] + ["x", "y"])
    rows = [(None, t, 1), (7, t, 2), (2, near, 3), (2, near, 3), (2, other, 4), (None, other, 5), (None, "only this has no id at all", 6), (None, None, 7), (9, "", 8), (9, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.components(docs).collect())
    assert out == sorted([(0, 56, 2), (7, 56, 2), (2, 56, 2), (2, 56, 2), (2, 56, 2), (0, 56, 2), (0, 3, 0), (0, 0, 0), (9, 0, 9), (9, 0, 9)])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [3, 4, 6, 7, 8, 8]


def test_overlap_bound_is_never_too_low():
    r = np.random.RandomState(1)
    for n, m in ((5, 9), (60, 400), (3000, 2900)):
        a, b = (np.unique(r.randint(0, 2**62, k).astype(np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate((b, a[: n // 2])))
        shared = len(np.intersect1d(a, b))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) >= shared


def test_matching_statistics_by_brute_force():
    r = np.random.RandomState(2)
    text = np.concatenate([np.append(r.randint(1, 4, n), 0) for n in r.randint(1, 30, 40)])
    owners = r.randint(0, 9, len(text))
    index = fm_index.FMIndex(text, 4, 6, owners)
    ends = np.arange(len(text))
    length, lo, hi = index.matching_statistics(text, ends, 6)
    runs = lambda n: [tuple(text[i : i + n]) for i in range(len(text) - n + 1)]
    for e in ends.tolist():
        own = [tuple(text[e + 1 - n : e + 1]) for n in range(1, min(6, e + 1) + 1)]
        best = max((len(w) for w in own if 0 not in w and runs(len(w)).count(w) > 1), default=0)
        assert length[e] == best
        if 0 < best:
            places = [i for i, w in enumerate(runs(best)) if w == tuple(text[e + 1 - best : e + 1])]
            assert sorted(index.owners[lo[e] : hi[e]]) == sorted(owners[places])


def test_substring_dedup(docs, texts, empty):
    out, seen = by_id(substring_dedup.deduplicate(docs)), {}
    for k in sorted(texts):
        w = (texts[k] or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if seen.setdefault(tuple(w[i : i + 13]), k) < k:
                keep[i : i + 13] = [False] * 13
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        assert (out[k]["n_words"], out[k]["n_removed"], out[k]["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in out.values()) > 500 and substring_dedup.deduplicate(empty).count() == 0


def test_substring_dedup_of_repeated_and_null_ids(spark):
    """A window goes only where a smaller id has it, in the text that holds it, however often and with what else an id occurs."""
    shared, other = sentences(1, 30, "abcdefgh").split(), sentences(2, 40, "klmnop").split()
    rows = [
        (1, [*shared, "tail"]), (2, ["head", *shared]), (2, other), (2, other), (3, [*other, *shared]), (3, [*sentences(3, 20, "xyz").split(), *other]),
        (None, shared), (None, other), (5, sentences(4, 50, "rst").split()), (5, sentences(4, 50, "rst").split()),
    ]
    seen: dict = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            if i is not None:
                seen.setdefault(tuple(w[k : k + 13]), set()).add(i)
    expected = []
    for i, w in rows:
        gone = {j for k in range(len(w) - 12) if i is not None and min(seen[tuple(w[k : k + 13])]) < i for j in range(k, k + 13)}
        expected.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    found = substring_dedup.deduplicate(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)).drop("kept_text").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected)) and [x[2] for x in expected] == [0, 30, 0, 0, 70, 40, 0, 0, 0, 0]


def test_decontamination(spark, docs, texts, empty):
    items = [(k, t) for k, t in enumerate([" ".join(WORD.findall(texts[k])[5:40]) for k in (12, 31, 60)] + ["not there at all in any text", "", None, "ONE", "日本 🎉"])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t, n=5):
        w = t.encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        size = min(5, len((t or "").split()))
        own = shingles(t, size) if size else set()
        want |= {(k, i) for k, d in texts.items() if own and len(own & shingles(d or "", size)) >= 0.75 * len(own)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()} == want and {(3, 6), (4, 6), (5, 7)} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench, block_bytes=64).collect()} == want
    left = {r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()}
    assert left == set(texts) - {k for k, _ in want}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(empty, bench).count() == 0


@pytest.mark.parametrize("n", range(1, 70))
def test_a_sketch_is_long_enough(n):
    missing = n - -(-75 * n // 100)  # so many shingles can be missing at containment 0.75
    assert decontaminate.sketch_size(n) >= min(n, missing + 1)


def secret_spans(t):
    kinds = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    ok = [lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(t) if ok[k](m))


SECRETS = ["é token = 'abcdefghijkl' API_KEY:\"x.y-z_12345678\"", "AKIA1234567890ABCD AKIA12", "deadbeefdeadbeef 0123456789abcdef0 dead", "bearer q8Zr1Lw0Xv7Tn3Kp9Sd5Fg2H done", "password: aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "Secret= short, token=\ntoken=abcdefghijklm"]


def test_secrets(spark, docs, texts, empty):
    more = spark.createDataFrame([(1000 + k, t, None, None, None) for k, t in enumerate(SECRETS)], SCHEMA)
    out = by_id(secrets.scan_documents(docs.unionByName(more)))
    for k, t in {**texts, **{1000 + k: t for k, t in enumerate(SECRETS)}}.items():
        want = secret_spans(t or "")
        assert out[k]["base_sha256"] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[b]}:{a}:{c}" for a, b, c in want).encode()).hexdigest()
        assert [out[k][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(b == j for _, b, _ in want) for j in range(3)]
    assert out[1003]["spans"] == "novel:7:31" and out[1004]["n_novel"] == 0
    assert out[1000]["n_measured"] == 2 and out[1000]["n_placeholder"] >= 1 and (out[1003]["n_measured"], out[1003]["n_placeholder"]) == (1, 0)
    clean = by_id(secrets.scan_documents(more, redact="[X]"))
    assert clean[1003]["text"] == "bearer [X] done" and "abcdefghijkl" not in clean[1000]["text"] and secrets.scan_documents(empty).count() == 0


def test_novelty_of_spans_by_brute_force(spark):
    import zstandard

    r = random.Random(8)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 1)) + "7"
    texts = [f"{sentences(k, 20, 'abcdefgh')} {'bearer' if k % 2 else 'plain'} {key(28) if k % 3 else 'version1_' * 4} {sentences(k, 20, 'abcdefgh')}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dictionary = secrets.identifiers(docs)
    words = Counter(w for t in texts for w in set(re.findall(r"\b[A-Za-z][A-Za-z_]{3,23}\b", t)))
    often = sorted((w for w, n in words.items() if n >= 5), key=lambda w: (-words[w], w))
    assert dictionary.split() == [*reversed(often), *secrets.IDENTIFIERS.split()] and "bearer" in often
    primed = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda t: len(primed.compress(t.encode()))
    for x in secrets.scan_documents(docs, dictionary=dictionary).collect():
        t, want = x["text"], []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", t):
            near = t[max(0, m.start() - 512) : m.start()] + "\n" + t[m.end() : m.end() + 512] + "\n"
            if "bearer" in t[max(0, m.start() - 48) : m.start()] and size(near + m[0]) - size(near) >= 4 + 0.6 * len(m[0]):
                want.append(f"novel:{m.start()}:{m.end()}")
        assert x["spans"] == ",".join(want) and bool(want) == (x["doc_id"] % 2 == 1 and x["doc_id"] % 3 != 0)


def test_novelty_of_short_and_plain_tokens(spark):
    """Keys without digits, of one case or of 12 characters are found behind sensitive words, words there and keys elsewhere aren't."""
    r = random.Random(9)
    pools = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows, keys, plain = [], {}, {}
    for k in range(240):
        filler = sentences(k, 60, "abcdeghilmnoprstu")
        key = "".join(r.choice(pools[k % 3]) for _ in range((12, 16, 24, 32)[k % 4]))
        word = f"{r.choice('aeiou')}n{sentences(k, 1, 'ersti')}tionable-{sentences(k, 1, 'nrst')}ing"
        token, name = (word if k % 5 == 0 else key), ("colour" if k % 5 == 1 else "the credential is")
        text = f"{filler} {name} {token} and {filler[::-1]}"
        (plain if k % 5 < 2 else keys)[k] = f"novel:{text.index(token)}:{text.index(token) + len(token)}"
        rows.append((k, text))
    out = by_id(secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    found = sum(span in out[k]["spans"].split(",") for k, span in keys.items())
    assert found >= 0.9 * len(keys) and sum(out[k]["spans"] == "" for k in plain) >= 0.95 * len(plain)
    assert sum(r["n_measured"] for r in out.values()) >= len(keys)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_spans(t):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PII.items()) for m in re.finditer(p, t) if ok(k, m[0]))


PRIVATE = ["é a.b@c.de_d@e.fr x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.255", "4539 1488 0343 6467 and 4539148803436468", "+1 (017) 555-7713 +1234 +12345678901234567", "@.@ a@b.c..d +9 9"]


def test_pii(spark, docs, texts, empty):
    more = spark.createDataFrame([(1000 + k, t, None, None, None) for k, t in enumerate(PRIVATE)], SCHEMA)
    out = by_id(pii.detect(docs.unionByName(more)))
    for k, t in {**texts, **{1000 + k: t for k, t in enumerate(PRIVATE)}}.items():
        want = pii_spans(t or "")
        text = ",".join(f"{list(PII)[b]}:{a}:{c}" for a, b, c in want)
        assert out[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (k, text, out[k]["spans"])
        assert [out[k][f"n_{n}"] for n in PII] == [sum(b == j for _, b, _ in want) for j in range(4)]
    assert out[8]["spans"] == "" and pii.detect(empty).count() == 0


def test_pii_finds_what_stands_behind_trusted_words(spark):
    rows = [(k, f"write me at user{k}@mail.example.org please") for k in range(40)] + [(50, "write me at user51(at)mail.example.org please"), (51, "room 123456 is elsewhere")]
    out = by_id(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[50]["spans"].startswith("context:12:") and out[51]["spans"] == ""


def test_pii_recall_of_planted_identifiers(spark):
    r = random.Random(3)
    rows, planted = [], {}
    for k in range(600):
        filler, kind = sentences(k, 12, "abcdefgh"), k % 3
        entity = f"user{k}@mail.example.org" if k < 450 else "".join(r.choice("0123456789abcdef") for _ in range(9)) + "7x"
        front = ("my address is ", "contact: ", f"{sentences(9000 + k, 1, 'xyz')} ")[kind]
        text = f"{filler} {front}{entity}{' wrote this' if kind == 2 else ' ' + filler}"
        if k >= 450:
            planted[k] = f"context:{text.index(entity)}:{text.index(entity) + len(entity)}"
        rows.append((k, text))
    rows += [(1000 + k, f"{sentences(k, 9, 'klmn')} room {100000 + k} {sentences(k, 3, 'klmn')}") for k in range(50)]
    out = by_id(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(out[k]["spans"] == span for k, span in planted.items()) >= 0.9 * len(planted)
    assert all(out[1000 + k]["spans"] == "" for k in range(50))


def test_pii_trusts_no_place_of_ordinary_words_and_no_refused_number(spark):
    """Patterns by brute force: what stands behind "id:" is mostly identifiers, what stands behind "the" is not."""
    r = random.Random(4)
    rows = [(k, f"the mail id: user{k}@mail.example.org of the house and the garden, the {'user' + str(k) + '@mail.example.org' if k % 4 == 0 else 'tree'} there") for k in range(80)]
    rows += [(100, "see id: 4539148803436468 there"), (101, "see id: 300.1.1.1 there"), (102, "see id: +1234567 there"), (103, "see id: kx77-4410-b there"), (104, "see the kx77-4410-b there"), (105, "read the 88a41x0 there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {x["pattern"]: x for x in pii.patterns(pii.scan(docs), docs.selectExpr("text as t")).collect()}
    words = [t.lower().split() for _, t in rows]
    behind = lambda w: sum(x == w for ws in words for x in ws[:-1])
    assert scored["1 the"]["seeds"] == 20 and scored["1 the"]["confidence"] < 22 / (behind("the") + pii.PRIOR) + 1e-9 < 0.1
    assert scored["1 id:"]["confidence"] > 80 / (behind("id:") + pii.PRIOR) - 1e-9 > 0.9
    out = by_id(pii.detect(docs))
    assert [out[k]["n_context"] for k in range(100, 106)] == [0, 0, 0, 1, 0, 0] and all(out[k]["n_context"] == 0 for k in range(80))


def test_pii_is_not_quadratic_in_the_matches(spark):
    text = "id 100000 " * 30_000 + "1.2.3.4 " * 3_000
    began = time.time()
    found = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found["n_ip"], found["n_context"]) == (3_000, 0) and found["spans"].endswith(f"ip:{len(text) - 8}:{len(text) - 1}") and time.time() - began < 60


def test_quality_rules(spark, docs, texts, empty):
    out = by_id(quality_rules.features(docs))
    for k, t in texts.items():
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))
        assert tuple(out[k][c] for c in quality_rules.BASE) == want, k
    rows = [(k, sentences(k, 40, "abcdefg") if k % 2 else " ".join(w + "!!" for w in sentences(k, 40, "ABCDEFG").split())) for k in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rules = quality_rules.learn(own, labels)
    kept = by_id(quality_rules.judge(own, rules))
    assert rules and all(kept[k]["kept"] == bool(k % 2) for k in range(200))
    assert quality_rules.learn(own, labels.limit(0)) == [] and quality_rules.judge(empty, []).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(2)
    bad = ["idiot", "1d1ot", "mоrоn", "clown!", "Idiöt"]
    rows = [(k, sentences(k, 60, "abcdefgh") + (" " + " ".join(r.choice(bad) for _ in range(3)) if k % 2 else "")) for k in range(300)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(own.where("doc_id % 5 <> 0"), labels, least_z=3.5)  # 240 rows are few
    out = by_id(toxicity.score(own, model))
    assert all(out[k]["predicted"] == k % 2 for k in range(0, 300, 5))
    odd = by_id(toxicity.score(docs.withColumnRenamed("source", "hits"), model))
    assert len({odd[k]["score"] for k in (0, 1, 2, 3, 4)}) == 1 and all(0 <= x["score"] <= 1 for x in odd.values())
    assert toxicity.fit(empty, labels.limit(0)).weights == {} and toxicity.score(empty, model).count() == 0
    model.exceptions = [" idiot savant "]

    def expected(t):
        padded = f" {' '.join(toxicity.fold(t))} "
        at = lambda e: [i for i in range(len(padded)) if padded.startswith(e, i)]
        spared = [(i, i + len(e)) for e in model.exceptions for i in at(e)]
        hits = [e for e in model.weights for i in at(e) if not any(a <= i and i + len(e) <= b for a, b in spared)]
        total, w = sum(model.weights[e] for e in hits), model.curve
        x = w[0] + w[1] * math.log(1 + total) + w[2] * math.log(1 + 100 * total / (len(padded.split()) + 10)) + w[3] * math.log(1 + len(set(hits)))
        return len(hits), 1 / (1 + math.exp(-x))

    told = by_id(toxicity.score(own, model))
    for k, t in rows[:40]:
        hits, s = expected(t)
        assert told[k]["hits"] == hits and math.isclose(told[k]["score"], s, rel_tol=1e-9)
    assert expected("idiot savant idiot")[0] == 1
    spared = by_id(toxicity.score(spark.createDataFrame([(1, "an idiot savant"), (2, "an idiot")], "doc_id long, text string"), model))
    assert spared[1]["hits"] == 0 and spared[2]["hits"] == 1


def test_importance_sampling(spark, docs, empty, monkeypatch):
    r = random.Random(6)
    words = [sentences(7, 40, "abcdefgh").split(), sentences(8, 40, "ABCDxyz!").split()]
    rows = [(k, " ".join(r.choice(words[k % 2]) for _ in range(50))) for k in range(400)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400, 3)], "doc_id long, quality int")
    out = importance_sampling.resample(own, labels, share=0.5).collect()
    chosen = {r["doc_id"] for r in out if r["selected"]}
    assert len(chosen) == 200 and sum(k % 2 for k in chosen) > 195
    order = sorted(out, key=lambda r: (-r["noisy"], r["doc_id"]))
    assert chosen == {r["doc_id"] for r in order[:200]}
    good = [t for k, t in rows if k % 3 == 0 and k % 2]

    def model(texts):  # words and pairs by bucket, in plain Python but for the word hashes
        counts = [0.5] * importance_sampling.BUCKETS
        for t in texts:
            for b in grams(t):
                counts[b] += 1
        total = sum(counts)
        return [math.log(c / total) for c in counts]

    def grams(t):
        h = [hash_words(np.frombuffer(w.lower().encode(), np.uint8))[0] for w in t.split()]
        pairs = [chained(np.concatenate(h[i : i + 2]), 2) for i in range(len(h) - 1)]
        return [int(x[0] % np.uint64(importance_sampling.BUCKETS)) for x in [*h, *pairs]]

    target, raw = model(good), model([t for _, t in rows])
    for x in out[::20]:
        g = grams(rows[x["doc_id"]][1])
        assert x["log_weight"] == pytest.approx(importance_sampling.SHARPNESS * sum(target[b] - raw[b] for b in g) / len(g), abs=1e-6)
    monkeypatch.setattr(importance_sampling, "_SORTED", 10)
    assert {r["doc_id"] for r in importance_sampling.resample(own, labels, share=0.5).collect() if r["selected"]} == chosen
    every = by_id(importance_sampling.resample(docs, labels.limit(0), share=0.3))
    assert sum(r["selected"] for r in every.values()) == round(0.3 * len(every)) and {r["log_weight"] for r in every.values()} == {0.0}
    assert importance_sampling.resample(empty, labels).count() == 0
