"""Byte-level BPE by recursive queries over token-position rows.

Each task splits its texts into words with the vocabulary's pattern. Words that the task has not
met go to an in-process DuckDB as lists of bytes. A recursive query lays them out as token-position rows, joins
neighbouring tokens with the merge table and contracts each word's leftmost pair of smallest rank, with
its further places at once, until no word has a pair left; an ordered aggregation joins the ids
with the vocabulary and puts their bytes together again. A text's ids and bytes are those of its words in order.

A query goes as many rounds as its rows allow (ROUND_ROWS); words that are not done then go on in the
next one, so that a word of any length takes the same way in bounded memory.

Documents don't leave their partition: there is no shuffle, and a lost executor costs its
own partitions only. What a task holds ends with it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import chunks

#: Rows that begin one recursive query, in bytes of words, and rows that all its rounds make.
QUERY_BYTES, ROUND_ROWS = 300_000, 2_500_000
#: Characters of the texts that are encoded together, and words that a task remembers.
GROUP_CHARS, WORDS = 1_500_000, 500_000

#: A word is a list of tokens. Each round lays the lists of unfinished words out as rows of position, token and next
#: token, joins these with the merge table, and contracts each word's leftmost pair of smallest rank. In a list of
#: more than LONG tokens the places further right that the same rank would take next go with it (of a run of equal tokens
#: every second one begins a pair), and the list is put together again from its rows.
LONG = 64
ENCODE_SQL = """
CREATE OR REPLACE TEMP TABLE ended AS
WITH RECURSIVE state(word, toks, going, round) AS (
  SELECT word, toks, true, 0 FROM start_words
  UNION ALL
  (WITH open_words AS MATERIALIZED (
     SELECT word, toks, round FROM state WHERE going AND round < $rounds
   ), best AS MATERIALIZED (
     SELECT t.word, min((m.rank::BIGINT << 32) + t.i) AS place
     FROM (SELECT word, unnest(toks) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks, 1) AS i FROM open_words) t
     JOIN merges m ON m.l = t.l AND m.r = t.r GROUP BY t.word
   ), long AS MATERIALIZED (
     SELECT w.word, w.toks, b.place >> 32 AS rank FROM best b JOIN open_words w ON w.word = b.word WHERE len(w.toks) > $long
   ), places AS MATERIALIZED (
     SELECT word, rank, i
     FROM (SELECT word, rank, i, twins, row_number() OVER (PARTITION BY word, run ORDER BY i) AS nth
           FROM (SELECT t.word, t.rank, t.i, t.l = t.r AS twins, t.i - row_number() OVER (PARTITION BY t.word ORDER BY t.i) AS run
                 FROM (SELECT word, rank, unnest(toks) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks, 1) AS i FROM long) t
                 JOIN merges m ON m.l = t.l AND m.r = t.r AND m.rank = t.rank))
     WHERE NOT twins OR nth % 2 = 1
   ), rebuilt AS (
     SELECT t.word, list(coalesce(h.rank::INT, t.tok) ORDER BY t.i) AS toks
     FROM (SELECT word, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM long) t
     LEFT JOIN places h ON h.word = t.word AND h.i = t.i
     WHERE NOT EXISTS (SELECT 1 FROM places g WHERE g.word = t.word AND g.i + 1 = t.i)
     GROUP BY t.word
   )
   SELECT w.word, CASE WHEN b.place IS NULL THEN w.toks ELSE coalesce(r.toks, w.toks[:(b.place & 4294967295) - 1] || [(b.place >> 32)::INT] || w.toks[(b.place & 4294967295) + 2:]) END, b.place IS NOT NULL, w.round + 1
   FROM open_words w LEFT JOIN best b ON b.word = w.word LEFT JOIN rebuilt r ON r.word = w.word)
)
SELECT word, toks, going FROM state WHERE NOT going OR round = $rounds
"""
DECODE_SQL = """
SELECT w.word, w.toks AS ids, d.chars
FROM ended w
JOIN (SELECT e.word, string_agg(v.chars, '' ORDER BY e.pos) AS chars
      FROM (SELECT word, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM ended WHERE NOT going) e
      JOIN vocabulary v ON v.tok = e.tok GROUP BY e.word) d ON d.word = w.word
WHERE NOT w.going
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=1)
def _tables(path: str):
    """The merge table (a pair for each way to cut a token in two), the vocabulary, and the token of each byte."""
    import pyarrow as pa

    ranks = read_ranks(path)
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    merges = pa.table({c: pa.array(x, pa.int32()) for c, x in zip(("l", "r", "rank"), zip(*pairs, strict=True), strict=True)})
    # A byte is the character of its number, so that text aggregation joins bytes.
    vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in ranks]})
    return merges, vocabulary, [ranks[bytes([i])] for i in range(256)], max(ranks.values())


class WordCoder:
    """Encodes and decodes texts; one for each task."""

    def __init__(self, vocabulary_path: str, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.np, self.pa = np, pa
        merges, vocabulary, byte_id, self.largest = _tables(vocabulary_path)
        self.pattern, self.byte_id = regex.compile(pattern), np.array(byte_id, np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "180MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows_in", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
            self.db.unregister("rows_in")
        self._forget()

    def close(self) -> None:
        self.db.close()
        self._forget()

    def _forget(self) -> None:
        """No words known: their ids one after the other and how many each has, and the same for their bytes."""
        np = self.np
        self.number: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.chars, self.n_chars = np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def _query(self, words: list[bytes]):
        """(ids of the words one after the other, how many each has, the bytes they decode to, how many)."""
        import pyarrow.compute as pc

        np, pa = self.np, self.pa
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        tokens = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), self.byte_id[np.frombuffer(b"".join(words), np.uint8)])
        rows = pa.table({"word": np.arange(len(words), dtype=np.int32), "toks": tokens})
        order, ids, n_ids, chars = [], [], [], []
        while rows.num_rows:
            self.db.register("start_words", rows)
            self.db.execute(ENCODE_SQL, {"long": LONG, "rounds": max(8, ROUND_ROWS // pc.sum(pc.list_value_length(rows["toks"])).as_py())})
            done = self.db.sql(DECODE_SQL).to_arrow_table()
            order.append(done["word"].to_numpy())
            for lists in done["ids"].chunks:
                ids.append(lists.flatten().to_numpy(zero_copy_only=False))
                n_ids.append(lists.value_lengths().to_numpy(zero_copy_only=False))
            chars += done["chars"].to_pylist()
            rows = self.db.sql("SELECT word, toks FROM ended WHERE going").to_arrow_table()
        place = np.argsort(np.concatenate(order))
        n_chars, decoded = np.fromiter(map(len, chars), np.int64, len(chars)), np.frombuffer("".join(chars).encode("latin-1"), np.uint8)
        return *chunks.spread(np.concatenate(ids).astype(np.int32), np.concatenate(n_ids).astype(np.int64), place), *chunks.spread(decoded, n_chars, place)

    def _learn(self, words: list[str]) -> None:
        """Encode new distinct words."""
        np, found, group, size = self.np, [], [], 0
        for i, w in enumerate(words):
            raw = w.encode()
            group.append(raw)
            size += len(raw)
            if size >= QUERY_BYTES or i == len(words) - 1:
                found.append(self._query(group))
                group, size = [], 0
        if found:
            old = (self.ids, self.n_ids, self.chars, self.n_chars)
            self.ids, self.n_ids, self.chars, self.n_chars = (np.concatenate([a, *parts]) for a, parts in zip(old, zip(*found, strict=True), strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple]:
        """For each text its ids, and the bytes that they decode to, as arrays."""
        np, pa = self.np, self.pa
        for group in chunks.in_groups(texts, GROUP_CHARS):
            if len(self.number) > WORDS:
                self._forget()
            pieces, sizes = chunks.split_all(pa.array([texts[i] for i in group], pa.string()))
            first = np.cumsum(sizes) - sizes
            # A text's first piece has no space before it.
            firsts = pieces.take(pa.array(first)).to_pylist()
            coded = pieces.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            known = coded.dictionary.to_pylist()
            index[first] = len(known) + np.arange(len(firsts))
            split = [self.pattern.findall(" " + p) for p in known] + [self.pattern.findall(p) for p in firsts]
            number, at = self.number, len(self.number)
            words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64)
            self._learn(list(number)[at:])
            each = np.fromiter(map(len, split), np.int64, len(split))
            words, n = chunks.spread(words, each, index)
            # Words of each text: its pieces' together.
            behind = np.append(0, np.cumsum(n))[np.append(first, len(n))]
            ids, n_ids = chunks.spread(self.ids, self.n_ids, words)
            ends = np.append(0, np.cumsum(n_ids))[behind]
            back, n_back = chunks.spread(self.chars, self.n_chars, words)
            back_ends = np.append(0, np.cumsum(n_back))[behind]
            for a, b, c, d in zip(ends[:-1], ends[1:], back_ends[:-1], back_ends[1:], strict=True):
                yield ids[a:b], back[c:d]


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "ids") -> DataFrame:
    """One row for each row of ``docs``: the id, n_tokens, and what ``keep`` names.

    keep="ids": ``ids`` array<int> and ``decoded`` binary. keep="digests": ``ids_sha256`` (of the
    decimal ids joined by one space) and ``decoded_sha256``, taken of the same ids and bytes
    in the task so that they need not be sent on. A null text counts as empty: no tokens. The
    vocabulary file must be at ``vocabulary_path`` on every machine. Other columns are ignored.
    """
    digests = keep == "digests"
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = WordCoder(vocabulary_path, pattern)
        decimal = np.array([b"%d" % i for i in range(words.largest + 1)], object)
        names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        types = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
        try:
            for batch in batches:
                n, a, b = [], [], []
                for ids, back in words.encode([t or "" for t in batch.column(1).to_pylist()]):
                    n.append(len(ids))
                    a.append(hashlib.sha256(b" ".join(decimal[ids].tolist())).hexdigest() if digests else ids)
                    b.append(hashlib.sha256(back).hexdigest() if digests else back.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, types[0]), pa.array(b, types[1])], names=names)
        finally:
            words.close()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
