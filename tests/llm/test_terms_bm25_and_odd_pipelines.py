"""Terms that give personal data away and BM25 retrieval against plain Python; rows without an id; the whole pipeline on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from ferrymass.llm import byte_bpe, decontam, langid, line_templates, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# Terms


def _near(text, spans):
    for start, kind, end, *_ in spans:
        for low, high in ((max(0, start - pii.WINDOW), start), (end, min(len(text), end + pii.WINDOW))):
            for m in regex.finditer(r"\p{L}{3,}", text[low:high]):
                if (m.start() > 0 or low in (0, end)) and (low + m.end() < high or high in (len(text), start)):
                    yield kind, m[0].lower()


def _disclosing(rows):
    """rows: (text, entities)."""
    joint, often, kinds = Counter(), Counter(), Counter()
    for text, spans in rows:
        joint.update(set(_near(text, spans)))
        often.update(set(regex.findall(r"\p{L}{3,}", text.lower())))
        kinds.update({s[1] for s in spans})
    total, out = len(rows), set()
    for (kind, term), both in joint.items():
        if both >= pii.SUPPORT and kinds[kind] < total and math.log(both * total / (often[term] * kinds[kind])) / math.log(total / kinds[kind]) > pii.DISCLOSURE:
            out.add(term)
    return out


def _cleaned(text, spans):
    out, at = "", 0
    for start, kind, end, *_ in spans:
        if start >= at:
            name = pii.KINDS[kind]
            out += text[at:start] + ("" if name == "term" else f"[{name.upper()}]")
            at = end
    return out + text[at:]


def test_terms_and_clean_texts(spark, docs):
    told = [(k, f"{name} lives near harbour house{k % 7} mail a{k}@ex.org or {name} so" if k % 3 else f"plain text {k} of harbour words") for k, name in enumerate(["zorblax", "quimby", "vexille"] * 9)]
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in told], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    rows = {r["doc_id"]: r for r in pii.find_pii(frame).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    term = pii.KINDS.index("term")
    entities = {k: [s for s in r["all"] if s["kind"] != term] for k, r in rows.items()}
    terms = _disclosing([(texts[k], entities[k]) for k in rows])
    assert terms
    for k, r in rows.items():
        masked = list(texts[k])
        for s in entities[k]:
            masked[s["start"] : s["end"]] = "0" * (s["end"] - s["start"])
        want = [(m.start(), m.end()) for m in regex.finditer(r"\p{L}{3,}", "".join(masked)) if m[0].lower() in terms]
        assert [(s["start"], s["end"]) for s in r["all"] if s["kind"] == term] == want
        assert r["clean"] == _cleaned(texts[k], sorted(map(tuple, r["all"])))


def test_many_entities_in_one_text(spark):
    text = " ".join(f"é wörd{i} a{i}@ex.org" for i in range(20_000))
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("size(base) AS n", "clean").first()
    assert r["n"] == 20_000 and r["clean"] == " ".join(f"é wörd{i} [EMAIL]" for i in range(20_000))


# BM25


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _held(texts, items):
    """Every text against every item: BM25 of all passages and entries in full, then both overlaps."""
    entries = [(i, Counter(w[a : a + decontam.ENTRY])) for i, t in items.items() if len(w := _words(t)) >= 5 for a in range(0, len(w), decontam.ENTRY)]
    df = Counter(t for _, c in entries for t in c)
    n, mean = len(entries), sum(c.total() for _, c in entries) / len(entries)
    impacts = []
    for i, c in entries:
        raw = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (decontam.K1 + 1) / (f + decontam.K1 * (1 - decontam.B + decontam.B * c.total() / mean)) for t, f in c.items()}
        impacts.append((i, {t: v / sum(raw.values()) for t, v in raw.items()}))
    out = {}
    for d, text in texts.items():
        own = _words(text)
        best = defaultdict(float)
        for p in range(0, len(own), decontam.ENTRY):
            passage = set(own[p : p + 2 * decontam.ENTRY])
            for i, impact in impacts:
                best[i] = max(best[i], sum(v for t, v in impact.items() if t in passage))
        have = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for i, t in items.items():
            w = _words(t)
            if len(w) < 5:
                if w and own == w:
                    out[d, i] = (1.0, 1.0, 1.0)
                continue
            met = [tuple(w[k : k + 5]) in have for k in range(len(w) - 4)]
            cut = decontam.question_words(t)
            share = lambda part: sum(part) / len(part) if part else sum(met) / len(met)  # noqa: B023, E731
            q, a = share([x for k, x in enumerate(met) if k + 5 <= cut]), share([x for k, x in enumerate(met) if k + 5 > cut])
            if best[i] >= decontam.BOUND - 1e-9 and sum(met) / len(met) >= decontam.OVERLAP and min(q, a) >= decontam.PART:
                out[d, i] = (best[i], q, a)
    return out


def test_retrieval_and_overlaps(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = list(items.items())
    for k, (_, t) in enumerate(some[:12]):  # parts of items, about as much of them as it takes
        w = t.split()
        texts[90_000 + k] = "before " * (150 * (k % 3)) + " ".join(w[: max(5, len(w) * (10 + k) // 20)] if k % 2 else w[len(w) * k // 30 :]) + " after" * 40
        texts[91_000 + k] = " ".join(x if j % (7 + k) else "other" for j, x in enumerate(w))
    items |= {70_000: "one two", 70_001: "", 70_002: None, 70_003: " ".join(f"w{j}" for j in range(300)), 70_004: some[0][1]}
    texts |= {92_000: "One  TWO", 92_001: "one two three", 92_002: " ".join(f"w{j}" for j in range(20, 300)), 92_003: None, 92_004: ""}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = _held(texts, items)
    found = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontam.contaminated(frame, bench).collect()}
    assert found.keys() == want.keys() and len(want) > 12
    assert all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


# Rows without an id

IDLESS = [(None, "Mail bob@example.org today please and thanks."), (None, "Mail bob@example.org today please and thanks."), (None, None), (1, "x"), (2**60 + 1, "Call +1 (499) 555-6503 now")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def idless(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None) for k, (i, t) in enumerate(IDLESS)], SCHEMA)


def _ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_rows_without_an_id(spark, idless):
    want = Counter(i for i, _ in IDLESS)
    found = pii.find_pii(idless)
    assert _ids(found) == want and sorted(r["n"] for r in found.selectExpr("size(base) AS n").collect()) == [0, 0, 1, 1, 1]
    assert _ids(line_templates.drop_templates(idless)) == want
    texts = spark.createDataFrame([(k, "the cat and the dog are here now" if k % 2 else "le chat et le chien sont ici", "en" if k % 2 else "fr") for k in range(200)], SCHEMA)
    both = texts.unionByName(idless)
    assert _ids(langid.identify(both)) == want + Counter(range(200)) - Counter([1]) + Counter([1])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1)], "doc_id long, quality int")
    scored = quality.classify(both, labels)
    assert scored.count() == 205 and scored.filter("doc_id IS NULL").count() == 3
    bench = spark.createDataFrame([(5, "Mail bob@example.org today please and thanks.")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontam.contaminated(idless, bench).collect()] == [(None, 5), (None, 5)]
    assert decontam.drop_contaminated(idless, bench).count() == 3


# Very long words


def test_very_long_words(spark):
    words = ["a" * 1_000_000, "".join(chr(0x4E00 + (k * k * 7919) % 20_000) for k in range(100_000)), "abcdefghij" * 40 + " " + "xyz" * 200]
    out = {r["doc_id"]: r for r in byte_bpe.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()}
    assert all(bytes(out[k]["decoded"]) == w.encode() for k, w in enumerate(words))
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert all(out[k]["ids"] == plain.encode_ordinary(words[k]) for k in (1, 2))


# The pipeline


def test_the_whole_pipeline_on_odd_rows(spark, docs, tmp_path):
    """Null, empty, blank, repeated and very long texts, null and shared ids, and columns of clashing names go through all stages."""
    clash = ["mark", "set", "keys", "label", "score", "uid", "key", "n", "_row"]
    base = docs.select("*", *[F.lit("c").alias(c) for c in clash])
    like = lambda i, t: (i, t, None, "s", None, *clash)
    odd = [like(None, None), like(None, ""), like(None, " \n\t"), like(50_001, None), like(50_002, "word " * 20_000), like(50_003, "w" * 200_000), *[like(None, "A plain sentence of some ten words that stands here twice.")] * 2, like(50_004, "One text of an id that has two, long enough to stay."), like(50_004, "Another text of that same id, and long enough as well.")]
    base.unionByName(spark.createDataFrame(odd, base.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    # Texts that go through are whole, and none stays under two ids; rows that repeat id and text stay or go together.
    kept = Counter(sha for _, sha in {(r["doc_id"], r["decoded_sha256"]) for r in rows})
    whole = {hashlib.sha256((t or "").encode()).hexdigest() for (t,) in base.select("text").collect()} | {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd}
    assert set(kept) <= whole and max(kept.values()) == 1
    spark.createDataFrame([], base.schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
