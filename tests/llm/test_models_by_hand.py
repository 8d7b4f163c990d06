"""Language models, the factorisation machine and line templates against plain Python that follows their definitions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrymass.llm import langid, line_templates, quality

SF = "/root/testdata/sf0.001"


def _letters(text):
    return re.sub(r"[^a-zé]+", " ", text.lower()).lstrip(" ")


class Plain:
    """Interpolated Kneser-Ney over four characters, from dictionaries."""

    def __init__(self, texts):
        four = Counter()
        for t in texts:
            own = "   " + _letters(t)
            four.update(own[i : i + 4] for i in range(len(own) - 3))
        self.counts = {4: four}
        for k in (3, 2):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.counts[1] = Counter(g[1:] for g in {g[2:] for g in four})
        self.floor = 1 / (len(self.counts[1]) + 1)

    def p(self, gram):
        out = self.floor
        for k in (1, 2, 3, 4):
            g = gram[4 - k :]
            own = {x: c for x, c in self.counts[k].items() if x[:-1] == g[:-1]}
            if own:
                total = sum(own.values())
                out = max(own.get(g, 0) - 0.75, 0) / total + 0.75 * len(own) / total * out
        return out

    def entropy(self, text):
        own = "   " + _letters(text)
        return -sum(math.log(self.p(own[i : i + 4])) for i in range(len(own) - 3)) / max(len(own) - 3, 1)


def test_kneser_ney_by_hand(spark):
    lines = {"aa": ["The cat sat on the mat.", "a cat, that cat!", "éa the", "mat mat"], "bb": ["lorem ipsum dolor", "dolor sit; amet", "ipsum lorem", "Sit ipsum sit"]}
    rows = [(k, t, lang) for lang, own in lines.items() for k, t in enumerate(own * 4, 100 * (lang == "bb"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {r["doc_id"] for r in frame.select("doc_id", (langid.held_out("doc_id") | (F.pmod(F.xxhash64("doc_id"), F.lit(langid.LEFT_OUT)) == 0)).alias("x")).filter("NOT x").collect()}
    plain = {lang: Plain([t for k, t, own in rows if own == lang and k in learnt]) for lang in lines}
    _, shards = langid.learn(frame)
    texts = ["the cat", "ipsum sat", "éé zz", "dolor the amet mat"]
    for text, (chars, nats) in zip(texts, shards[0].value.sums(texts), strict=True):
        assert nats / chars == pytest.approx([plain[x].entropy(text) for x in ("aa", "bb")], rel=1e-9)
    told = {r["text"]: r["lang_pred"] for r in langid.identify(frame.unionByName(spark.createDataFrame([(900 + k, t, None) for k, t in enumerate(texts)], frame.schema))).join(spark.createDataFrame([(900 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "doc_id").collect()}
    assert told == {t: min(("aa", "bb"), key=lambda x: plain[x].entropy(t)) for t in texts}


def test_sum_of_squares_is_the_sum_over_pairs():
    model, rng = quality.Machine(0.3, 5), np.random.default_rng(2)
    model.w = rng.normal(size=quality.WIDTH)
    for n in (1, 2, 9):
        index, value = rng.integers(0, quality.WIDTH, n), rng.normal(size=n)
        pairs = sum(model.v[index[a]] @ model.v[index[b]] * value[a] * value[b] for a in range(n) for b in range(a))
        want = 0.3 + (model.w[index] * value).sum() + pairs
        assert model.raw(index, value, np.array([0]))[0][0] == pytest.approx(want)


def test_scores_are_the_machines(spark):
    sf = SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").limit(40).collect()}
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    for k, t in texts.items():
        index, value = next(quality.features([t or ""]))
        pairs = sum(model.v[index[a]] @ (value[:a] @ model.v[index[:a]]) * value[a] for a in range(len(index)))
        raw = model.bias + (model.w[index] * value).sum() + pairs
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=1e-9)


def _plain_templates(texts, documents=3):
    tokens = lambda line: ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]
    leaf_of, docs_of, held = {}, defaultdict(set), defaultdict(set)
    for d, text in texts.items():
        for n, line in enumerate(text.split("\n")):
            t = tokens(line)
            if any(x != "<*>" for x in t):
                leaf = (len(t), *t[: line_templates.LEADING])
                leaf_of[d, n] = leaf, t
                docs_of[leaf].add(d)
                for place, x in enumerate(t):
                    held[leaf, place, x].add(d)
    named, recurs = {}, defaultdict(set)
    for (d, n), (leaf, t) in leaf_of.items():
        if len(docs_of[leaf]) >= documents:
            made = tuple(x if p < line_templates.LEADING or (x != "<*>" and len(held[leaf, p, x]) >= documents) else "<*>" for p, x in enumerate(t))
            constant = sum(x != "<*>" for x in made)
            if constant:
                needed = documents * 2 ** max(0, math.ceil(line_templates.CONSTANT * len(made) - constant))
                named[d, n] = (leaf, made), needed
                recurs[leaf, made].add(d)
    gone = {k for k, (name, needed) in named.items() if len(recurs[name]) >= needed}
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in texts.items()}


def test_templates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["kept_text"] for r in line_templates.drop_templates(docs).collect()}
    want = _plain_templates(texts)
    assert got == want and want != texts


def test_many_lines_of_one_text(spark):
    long = "\n".join(["Subscribe to our news today", *[f"own line {k:b} of text" if k % 3 else "Subscribe to our news today" for k in range(20_000)]])
    texts = {0: long, 1: "Subscribe to our news today\nb", 2: "a\nSubscribe to our news today", 3: "c"}
    got = {r["doc_id"]: r["kept_text"] for r in line_templates.drop_templates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _plain_templates(texts)
