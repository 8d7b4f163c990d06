"""Phrases, rules by line and periodic runs, against plain Python and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ferrymass.llm import phrases, quality_rules, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p long, w1 long, rank long, word string, n_words long, clean_text string, _words string, kept boolean"
EXTRA = ("s", 1, 2, 3, 4, "w", 5, "c", "x", True)
LOOP = "alpha beta gamma. " * 40
ROWS = [
    (1, None, None, *[None] * 10),
    (2, "", "en", *EXTRA),
    (3, "  \n\t \x0b", "en", *EXTRA),
    (4, LOOP, "en", *EXTRA),
    (4, LOOP, "en", *EXTRA),
    (5, LOOP, None, *EXTRA),
    (None, LOOP, "en", *EXTRA),
    (2**60 + 1, "Über den 🎉 Fluss,\tÜber den 🎉 Fluss!\nHome | About | Terms | Contact\nAll Rights Reserved\n" * 12, "de", *EXTRA),
    (6, "word " * 60_000, "xx", *EXTRA),
    (7, "a" * 300_000 + " b", "xx", *EXTRA),
    (8, "Home\nHome\nA line of plain words that ends well.\n#$% *** &&&\nA line of plain words that ends well.", "en", *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# Phrases


def _phrases(rows, support, top):
    words, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und"
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang].update(w)
            counts[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= support}
        covered = {g[i : i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * f[g[i : i + k]]}
        scored = []
        for g in found.keys() - covered:
            score, k = min((2_000_000 * f[g] // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, words[lang].total(), -score))
    return out


@pytest.mark.parametrize(("support", "top", "head"), [(30, 2000, 1 << 18), (5, 40, 20), (5, 2000, 0)])
def test_phrases(docs, support, top, head):
    want = _phrases([(r["text"], r["lang"]) for r in docs.collect()], support, top)
    found = phrases.collocations(docs, support=support, top=top, head=head).collect()
    assert want and {tuple(r) for r in found} == want and len(found) == len(want)


def test_phrases_in_small_buffers_with_hot_pivots(docs, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER", 64)
    monkeypatch.setattr(phrases, "SLICE", 100)
    monkeypatch.setattr(phrases, "HEAVY_SHARE", 10_000)  # most words are dealt over parts
    want = _phrases([(r["text"], r["lang"]) for r in docs.collect()], 8, 300)
    assert {tuple(r) for r in phrases.collocations(docs, support=8, top=300).collect()} == want


def test_phrases_of_odd_rows(odd, empty):
    want = _phrases([(r[1], r[2]) for r in ROWS], 30, 2000)
    assert {tuple(r) for r in phrases.collocations(odd).collect()} == want
    assert {r[0] for r in want} == {"en", "und", "xx"}
    assert phrases.collocations(empty).count() == 0


# Rules


def _failing(line):
    visible = len(re.sub("[\x20\x09-\x0d]", "", line))
    lower = line.lower()
    return 10 * len(re.findall(r"[#*$%&|<>!]", line)) > visible or line.count(" | ") >= 3 or (len(line.split()) < 4 and not re.search(quality_rules.END, line)) or any(b in lower for b in quality_rules.BOILERPLATE)


def _rules(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    good = [x for x in lines if not _failing(x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    chars, left = (sum(map(len, x)) for x in (lines, good))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed, not failed and 100 * (chars - left) <= 50 * chars, len(lines), len(lines) - len(good), chars - left, "\n".join(good)


def test_rules(docs, odd, empty):
    columns = [*quality_rules.COLUMNS[1:], "clean_text"]
    for frame in (docs, odd):
        rows = quality_rules.judge(frame).select("text", *columns).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert tuple(r)[1:] == _rules(r["text"]), r["text"] and r["text"][:200]
    assert quality_rules.judge(empty).count() == 0


def test_cleaned_documents(docs, odd):
    for frame in (docs, odd):
        out = quality_rules.clean(frame)
        assert out.columns == frame.columns
        want = sorted(x[-1] for r in frame.select("text").collect() if (x := _rules(r["text"]))[6])
        assert sorted(r["text"] for r in out.select("text").collect()) == want


def test_hashes_that_meet_are_told_apart(spark, monkeypatch):
    """Windows are compared word by word where their hashes repeat: with one hash for all, results stay."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *cols: F.when(F.lit(True), F.lit(7).cast("long")) if len(cols) == 1 else None)
    text = "a b c d e f g h a b c d e i j k"
    got = spark.createDataFrame([(text,), (text + " l",)], "t string").select(quality_rules.repeated_words(F.split("t", " ")).alias("n")).collect()
    assert [r["n"] for r in got] == [10, 10]


# Runs


def _runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _collapsed(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(told), sha(kept)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _sorted(rows):
    return sorted(rows, key=str)


def test_runs_of_documents(docs):
    short = docs.filter(F.length("text") < 12_000)
    found = [tuple(r) for r in runs.find_runs(short, plant=True).select(*COLUMNS).collect()]
    want = [_collapsed(r["doc_id"], r["text"]) for r in short.collect()]
    assert _sorted(found) == _sorted(want) and sum(r[1] for r in want) > 10


def test_runs_of_odd_rows(odd, empty):
    some = odd.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    found = [tuple(r) for r in runs.find_runs(some, plant=True).select(*COLUMNS).collect()]
    assert _sorted(found) == _sorted([_collapsed(r[0], r[1]) for r in ROWS if r[0] not in (6, 7)])
    long = {r["doc_id"]: r for r in runs.find_runs(odd).collect()}[6]
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["collapsed"]) == (1, 0, 60_000, 1, "word")
    assert runs.find_runs(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_few_words(seed):
    """Words of two or three kinds, with planted repetitions that nest and touch."""
    rng = random.Random(seed)
    for _ in range(60):
        words = [rng.choice("ab" if seed % 2 else "abc").encode() for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(4)):
            at, q, n = rng.randrange(len(words)), rng.randrange(1, 20), rng.randrange(1, 90)
            words[at:at] = (words[at : at + q] or [b"a"]) * (1 + n // q)
        assert runs.runs(words) == _runs(words)
    assert runs.K == 16
