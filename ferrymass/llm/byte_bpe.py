"""Byte-level BPE encoding and decoding with DuckDB queries in each partition.

A task splits its texts by the pre-tokenizer pattern, keeps the distinct words
it has not met yet, and encodes those with one recursive query: token-position
rows join the merge table, and every word contracts its leftmost pair of
minimum rank until none is left. The recursion is keyed by word and position, so
a word holds one row a position however many steps it takes. A step contracts all
pairs of a word's minimum rank from left to right where that is what one at a
time would give: if no merge that uses the new token has a rank as low, nothing
can come before the next of these pairs. Otherwise it contracts the leftmost only.

Ids are decoded by an ordered aggregation over position rows joined to the token
table, once for each word learnt: a text's bytes are those of its words in order.
The recursion takes a step for each rank that a word contracts, each over the
whole word, so words of over LONG bytes are contracted beside it by the same
table: the places of each rank are kept in a bucket, and ranks are taken in order.
What a task has learnt is freed at its end.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrymass.llm.store import give_back, small_batches

#: Words that a generation of a task's memory holds; two are kept, and forgetting the older one changes no result.
REMEMBERED = 300_000
#: Words, and bytes of words, that one recursive query takes at most; a longer word goes alone.
PER_QUERY = 50_000
BYTES_PER_QUERY = 500_000
SHORT = 48
#: Longer words are contracted by buckets, in some 40 bytes of memory a byte and 2 microseconds a merge.
LONG = 256
#: Words of texts that are held at a time, but for a longer text's own, and ids that one query decodes.
HELD = 640_000
DECODED = 100_000
#: Memory of a task's DuckDB, which never spills.
MEMORY = "150MB"

OUT = "doc_id long, ids array<int>, decoded binary"

#: Words of at most SHORT bytes, the leftmost pair a step. pick holds, from the top: the token made, the position of the left part, and the left part's width.
_ENCODE = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, 0 AS step FROM start
    UNION ALL
    (WITH pair AS (
        SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt, step FROM state
    ), ranked AS (
        SELECT p.word, p.pos, p.tok, m.merged, m.width, p.step FROM pair p LEFT JOIN merges m ON m.pair = p.tok::BIGINT * 16777216 + p.nxt
    ), best AS (
        SELECT word, min((merged::BIGINT << 40) + (pos::BIGINT << 12) + width) AS pick FROM ranked WHERE merged IS NOT NULL GROUP BY word
    )
    SELECT r.word, r.pos, CASE WHEN r.pos = (b.pick >> 12) & 268435455 THEN b.pick >> 40 ELSE r.tok END, r.step + 1
    FROM ranked r JOIN best b ON b.word = r.word WHERE r.pos <> ((b.pick >> 12) & 268435455) + (b.pick & 4095))
), last AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word AS doc, s.pos, s.tok::INTEGER AS tok FROM state s JOIN last USING (word, step)
"""

#: Longer words, all that a step allows.
_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM start
    UNION
    (WITH pair AS (
        SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS after, lag(tok) OVER w AS left_tok, lead(tok, 2) OVER w AS right_tok
        FROM recurring.state WHERE tok >= 0 AND word IN (SELECT word FROM state) WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
        SELECT p.*, m.merged FROM pair p JOIN merges m ON m.pair = p.tok::BIGINT * 16777216 + p.nxt
    ), low AS (
        SELECT word, min(merged) AS merged FROM ranked GROUP BY word
    ), met AS (
        SELECT r.*, lag(r.after) OVER (PARTITION BY r.word ORDER BY r.pos) IS NOT DISTINCT FROM r.pos AS touches
        FROM ranked r JOIN low l ON l.word = r.word AND l.merged = r.merged
    ), chain AS (
        SELECT *, sum(CASE WHEN touches THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run FROM met
    ), act AS (
        SELECT *, merged::BIGINT * 16777216 AS big FROM chain QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1
    ), watched AS (
        SELECT *, big + coalesce(right_tok, merged) IN (FROM early) OR coalesce(left_tok, merged)::BIGINT * 16777216 + merged IN (FROM early) OR big + merged IN (FROM early) AS wakes FROM act
    ), due AS (
        SELECT * FROM watched QUALIFY NOT coalesce(bool_or(wakes) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    )
    SELECT word, unnest([pos, after]), unnest([merged, -1]) FROM due)
)
SELECT word AS doc, pos, tok FROM state WHERE tok >= 0
"""

#: The bytes of a token are held as a string of one character a byte.
_DECODE = "SELECT i.doc, string_agg(t.bytes, '' ORDER BY i.pos) AS text FROM ids i JOIN tokens t ON t.tok = i.tok GROUP BY i.doc"


def merge_rows(data: bytes) -> pd.DataFrame:
    """Every way to make a token of two others: the pair's key, the token made (which is its rank), the left part's width in bytes, and whether the token ranks no later than a part of it."""
    ranks = _ranks(data)
    made = [(ranks[t[:k]], ranks[t[k:]], i, k) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right, merged, width = np.array(made, np.int64).reshape(-1, 4).T
    return pd.DataFrame({"pair": left * 16777216 + right, "merged": merged.astype(np.int32), "width": width.astype(np.int32), "early": (merged <= left) | (merged <= right)})


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def contract(word: np.ndarray, pairs: np.ndarray, merged: np.ndarray, made: dict[int, int]) -> np.ndarray:
    """The tokens of a word of any length, by its leftmost pair of minimum rank until none is left.

    pairs (sorted) and merged are the merge table as arrays, made is it as a
    dictionary. A place may stand in a bucket after its pair has gone; it is
    passed over then.
    """
    n = len(word)
    tok, after, before = array("i", word.tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
    keys = word[:-1].astype(np.int64) * 16777216 + word[1:]
    spot = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    places = np.flatnonzero(pairs[spot] == keys)
    ranks = merged[spot[places]]
    order = np.argsort(ranks, kind="stable")
    names, first = np.unique(ranks[order], return_index=True)
    buckets = {int(r): array("i", part.astype(np.int32).tobytes()) for r, part in zip(names, np.split(places[order], first[1:]), strict=True)} if len(names) else {}
    heap, get = list(buckets), made.get
    heapify(heap)
    while heap:
        rank = heappop(heap)
        own = array("i", np.sort(np.frombuffer(buckets.pop(rank), np.int32)).tobytes())
        for nth, i in enumerate(own):
            j = after[i]
            if tok[i] < 0 or j >= n or get(tok[i] * 16777216 + tok[j]) != rank:
                continue
            tok[i], tok[j], k, h = rank, -1, after[j], before[i]
            after[i], early = k, False
            for left, right in ((h, i), (i, k)):
                if right == k and k < n:
                    before[k] = i
                new = get(tok[left] * 16777216 + tok[right]) if left >= 0 and right < n else None
                if new is not None:
                    early |= new < rank
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        buckets[new] = array("i", [left])
                        heappush(heap, new)
            if early:  # a token that ranks before a part of it comes first
                buckets[rank] = own[nth + 1 :]
                heappush(heap, rank)
                break
    tokens = np.frombuffer(tok, np.int32)
    return tokens[tokens >= 0]


class Coder:
    """One task's DuckDB connection with the merge and token tables, and the words met so far."""

    def __init__(self, data: bytes, merges: pd.DataFrame, pattern: str):
        import duckdb
        import regex

        self.ranks = _ranks(data)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        self.merges, self.made = merges, None
        self._table("merges", merges[["pair", "merged", "width"]])
        self._table("early", merges.loc[merges["early"], ["pair"]])
        self._table("tokens", pd.DataFrame({"tok": np.array(list(self.ranks.values()), np.int32), "bytes": [t.decode("latin-1") for t in self.ranks]}))
        self.names = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # Ids and decoded bytes of the words met, and the generation before.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _table(self, name: str, rows: pd.DataFrame) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def close(self) -> None:
        self.db.close()
        self.known, self.older, self.ranks, self.names, self.made = ({}, {}), ({}, {}), {}, {}, None
        give_back()

    def learn(self, words: list[str]) -> None:
        """Ids and decoded bytes of words not known yet. Those that are tokens as a whole need no merging."""
        rest: list[tuple[str, bytes]] = []
        for w in words:
            blob = w.encode("utf-8", "surrogatepass")
            i = self.ranks.get(blob)
            if i is not None:
                self._keep(w, i.to_bytes(4, "little"), self.names[i])
            elif len(blob) > LONG:
                ids = self._contract(blob)
                self._keep(w, ids.astype("<u4").tobytes(), self.decode([ids])[0])
            else:
                rest.append((w, blob))
        rest.sort(key=lambda x: len(x[1]))  # words of like length take as many steps
        part: list[tuple[str, bytes]] = []
        size = 0
        for x in rest:
            if part and (len(part) >= PER_QUERY or size + len(x[1]) > BYTES_PER_QUERY or len(part[0][1]) <= SHORT < len(x[1])):
                self._merge(part)
                part, size = [], 0
            part.append(x)
            size += len(x[1])
        if part:
            self._merge(part)

    def _keep(self, word: str, ids: bytes, text: bytes) -> None:
        self.known[0][word], self.known[1][word] = ids, text

    def _contract(self, blob: bytes) -> np.ndarray:
        if self.made is None:
            table = self.merges.sort_values("pair")
            self.pairs, self.merged = table["pair"].to_numpy(), table["merged"].to_numpy()
            self.made = dict(zip(self.pairs.tolist(), self.merged.tolist(), strict=True))
        return contract(self.byte[np.frombuffer(blob, np.uint8)], self.pairs, self.merged, self.made)

    def _merge(self, words: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(b) for _, b in words])
        first = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        start = pd.DataFrame({"word": word, "pos": (np.arange(len(word)) - first[word]).astype(np.int32), "tok": self.byte[np.frombuffer(b"".join(b for _, b in words), np.uint8)]})
        self.db.register("start", start)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE ids AS {_ENCODE if lengths[-1] <= SHORT else _ENCODE_LONG}")
        self.db.unregister("start")
        found = self.db.execute("SELECT doc, tok FROM ids ORDER BY doc, pos").fetchnumpy()
        texts = self.db.execute(f"{_DECODE} ORDER BY i.doc").fetchnumpy()["text"].tolist()
        self.db.execute("DROP TABLE ids")
        flat = found["tok"].astype("<u4").tobytes()
        at = (4 * np.searchsorted(found["doc"], np.arange(len(words) + 1))).tolist()
        for (w, _), a, z, text in zip(words, at[:-1], at[1:], texts, strict=True):
            self._keep(w, flat[a:z], text.encode("latin-1"))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text, and the bytes that they decode to, in order. The words of one text are held at a time, and the new ones of a run of texts."""
        held: list[list[str]] = []
        size = 0
        for text in [*texts, None]:
            if text is None or size > HELD:
                yield from self._flush(held)
                held, size = [], 0
            if text is not None:
                held.append(self.pattern.findall(text))
                size += len(held[-1])

    def _flush(self, held: list[list[str]]) -> Iterator[tuple[np.ndarray, bytes]]:
        if len(self.known[0]) > REMEMBERED:
            self.older, self.known = self.known, ({}, {})
        fresh = set().union(*held) - self.known[0].keys()
        for w in fresh & self.older[0].keys():
            self._keep(w, self.older[0][w], self.older[1][w])
        self.learn(list(fresh - self.older[0].keys()))
        ids, text = (d.__getitem__ for d in self.known)
        for words in held:
            yield np.frombuffer(b"".join(map(ids, words)), "<u4"), b"".join(map(text, words))

    def decode(self, many: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of ids: the tokens' bytes in order of position."""
        out = [b""] * len(many)
        pieces = [(k, ids[a : a + DECODED]) for k, ids in enumerate(many) for a in range(0, len(ids), DECODED)]
        part: list[tuple[int, np.ndarray]] = []
        size = 0
        for x in [*pieces, None]:
            if part and (x is None or size + len(x[1]) > DECODED):
                sizes = [len(ids) for _, ids in part]
                doc = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
                self.db.register("ids", pd.DataFrame({"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "tok": np.concatenate([ids for _, ids in part]).astype(np.int32)}))
                found = dict(self.db.execute(_DECODE).fetchall())
                self.db.unregister("ids")
                for i, (k, _) in enumerate(part):
                    out[k] += found[i].encode("latin-1")
                part, size = [], 0
            if x is not None:
                part.append(x)
                size += len(x[1])
        return out


def _vocabulary(path: str) -> bytes:
    """The vocabulary file's bytes, read once on the driver: a fixed table of under 2 MB, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _coded(docs: DataFrame, id_col: str, text_col: str, path: str | None, row, schema: str) -> DataFrame:
    small_batches(docs.sparkSession)
    default, pattern = _default_vocabulary()
    data = _vocabulary(path or default)
    shared = docs.sparkSession.sparkContext.broadcast((data, merge_rows(data)))
    # A null beside large ids would turn an Arrow batch's ids into rounded floats.
    chosen = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["no_id", *[f.split()[0] for f in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(*shared.value, pattern)
        try:
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    part = batch.iloc[at : at + 1000]
                    many = coder.encode(part["text"].tolist())
                    rows = [(n, i, *row(ids, text)) for n, i, (ids, text) in zip(part["no_id"].tolist(), part["doc_id"].tolist(), many, strict=True)]
                    yield pd.DataFrame(rows, columns=names)
        finally:
            coder.close()

    coded = chosen.mapInPandas(run, f"no_id boolean, {schema}")
    return coded.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that the ids decode to, for every row of docs.

    vocabulary is the path of a .tiktoken file. A null or empty text has no ids
    and decodes to no bytes; texts and words of any length are coded whole. Rows
    that repeat, or share an id, are coded each; a
    null id stays null; an empty table gives no rows; other columns play no part.
    """
    return _coded(docs, id_col, text_col, vocabulary, lambda ids, text: (ids, text), OUT)


def _digest(ids: np.ndarray, text: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes, made beside the coder so that ids needn't leave the task. Rows as in encode."""
    return _coded(docs, id_col, text_col, vocabulary, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
