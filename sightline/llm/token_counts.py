"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A sequence of tokens is what the merges give exactly if they leave each adjacent pair of it as
it is. So the last token of each prefix follows from shorter prefixes: it is the one token that
ends there and stays beside the last token of what comes before it, and the count is that
prefix's count plus one. The vocabulary's end-of-word form closes each prefix. All distinct words of a
group of texts are tabled side by side, character by character; a text's table is those of its words
one after the other, each on top of the counts before it.

The tables are stored: the step from each prefix to the next in one byte, and the count and the
smallest count of each block of BLOCK prefixes. The longest prefix within a budget, or the count of a
truncated text, is then a lookup of one block in SQL, without encoding anything again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks

#: Prefixes in a block of a stored table.
BLOCK = 64
#: Characters of the texts that are tabled together, and table cells of words side by side: bounds memory.
GROUP_CHARS, CELLS = 2_000_000, 1_000_000
#: Remembered pairs of tokens.
PAIRS = 1_000_000
_END = 256
_LONG = 1 << 30


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else
    the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class IntMap:
    """Numbers from 0 on to numbers, looked up by the array (open addressing, at most half full)."""

    def __init__(self, room: int):
        import numpy as np

        self.np, bits = np, max(4, (2 * room - 1).bit_length())
        self.shift, self.mask, self.n, self.room = np.uint64(64 - bits), (1 << bits) - 1, 0, room
        self.keys, self.held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _places(self, keys):
        return ((keys.astype(self.np.uint64) * self.np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(self.np.int64)

    def get(self, keys):
        """What each key has; -1: nothing."""
        np = self.np
        out, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._places(keys)
        while len(left):
            found = self.keys[at]
            hit = found == keys
            out[left[hit]] = self.held[at[hit]]
            on = ~hit & (found >= 0)
            left, keys, at = left[on], keys[on], (at[on] + 1) & self.mask
        return out

    def put(self, keys, values) -> None:
        """Add distinct keys that are not there."""
        self.n += len(keys)
        at = self._places(keys)
        while len(keys):
            free = self.keys[at] < 0
            # Of keys that meet at a free place one gets it; the others go on.
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.held[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & self.mask


class PrefixTables:
    """Prefix tables of texts; one for each task."""

    def __init__(self, path: str):
        import numpy as np
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.np, self.end = np, model.get("end_of_word_suffix") or ""
        self.vocab = vocab = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        self.edges: tuple[dict, dict] = ({}, {})
        #: White space as the normaliser knows it; of these, only a space is left.
        self.white = [chr(c) for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
        # The tokens as paths of bytes; a last step _END stands for the end-of-word form.
        byte, steps, nodes = {c: i for i, c in enumerate(_byte_letters())}, {}, 1
        token_at = {}
        for token, number in vocab.items():
            if token in self.special:
                continue
            ended, at = bool(self.end) and token.endswith(self.end), 0
            for b in [*(byte[c] for c in (token.removesuffix(self.end) if ended else token)), *([_END] if ended else [])]:
                key = at * (_END + 1) + b
                if key not in steps:
                    steps[key], nodes = nodes, nodes + 1
                at = steps[key]
            token_at[at] = number
        self.steps, self.token_at = IntMap(len(steps)), np.full(nodes, -1, np.int32)
        self.steps.put(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps)))
        self.token_at[np.fromiter(token_at, np.int64, len(token_at))] = np.fromiter(token_at.values(), np.int32, len(token_at))
        self.size = max(vocab.values()) + 1
        self.token = dict(zip(vocab.values(), vocab, strict=True))
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in self.rank], np.int64)
        self.merges = IntMap(len(pairs))
        self.merges.put(pairs, np.fromiter(self.rank.values(), np.int32, len(pairs)))
        # For each side of each token what stands at its edge while it is made, largest first; filled when needed.
        deep = max(map(len, vocab))
        self.edge_token = np.full((2, self.size, deep), -1, np.int32)
        self.edge_taken = np.zeros((2, self.size, deep), np.int32)
        self.unmade = np.zeros(self.size, bool)
        self.pairs = IntMap(PAIRS)

    # --- words -----------------------------------------------------------------------------

    def _split_of(self, token: str) -> tuple[str, str] | None:
        """The pair whose merge makes ``token`` of its own symbols; None for a single symbol."""
        symbols = [*token.removesuffix(self.end)] if self.end and token != self.end else [token]
        if self.end and token.endswith(self.end):
            symbols[-1] += self.end
        pair = None
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, _LONG), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == _LONG:
                self.unmade[self.vocab[token]] = True
                return None
            pair = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = ["".join(pair)]
        return pair

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one edge of ``token`` while it is made, largest first, each
        with the rank of the merge that takes it in."""
        if (known := self.edges[side].get(token)) is None:
            pair = self._split_of(token)
            known = [(token, _LONG)]
            if pair:
                rank = self.rank[pair]
                known += [(t, rank if taken == _LONG else taken) for t, taken in self._edge(pair[side], side)]
            self.edges[side][token] = known
        return known

    def _stay(self, a, b):
        """Whether the merges of the two tokens' symbols end in these two tokens: no merge
        across their border comes before both its sides are taken in. Of equal ranks the left
        one comes first."""
        np = self.np
        keys = a.astype(np.int64) * self.size + b
        known = self.pairs.get(keys)
        if (new := known < 0).any():
            fresh = np.unique(keys[new])
            if self.pairs.n + len(fresh) > PAIRS:
                self.pairs = IntMap(max(PAIRS, len(fresh)))
            self.pairs.put(fresh, self._stay_anew(fresh // self.size, fresh % self.size).astype(np.int32))
            known[new] = self.pairs.get(keys[new])
        return known == 1

    def _stay_anew(self, a, b):
        np = self.np
        for side, tokens in ((1, a), (0, b)):
            for t in np.unique(tokens[self.edge_token[side, tokens, 0] < 0]).tolist():
                for i, (edge, taken) in enumerate(self._edge(self.token[t], side)):
                    self.edge_token[side, t, i], self.edge_taken[side, t, i] = self.vocab[edge], taken
        stay = ~(self.unmade[a] | self.unmade[b])
        for i in range(self.edge_token.shape[2]):
            x = self.edge_token[1, a, i]
            if not (x >= 0).any():
                break
            for j in range(self.edge_token.shape[2]):
                y = self.edge_token[0, b, j]
                at = np.flatnonzero((x >= 0) & (y >= 0) & stay)
                if not len(at):
                    break
                rank = self.merges.get(x[at].astype(np.int64) * self.size + y[at])
                merged = (rank >= 0) & (rank < self.edge_taken[1, a[at], i]) & (rank <= self.edge_taken[0, b[at], j])
                stay[at[merged]] = False
        return stay

    def _first(self, w, j, token, last, n: int):
        """Of the tokens that end at a place (of word ``w``, begun at ``j``), for each of the ``n`` words the row
        of the longest one that stays beside the last token of what comes before it; -1: none."""
        np = self.np
        rows = np.flatnonzero(token >= 0)
        before = last[w[rows], j[rows]]
        fit = j[rows] == 0
        ask = np.flatnonzero(~fit & (before >= 0))
        fit[ask] = self._stay(before[ask], token[rows[ask]])
        rows = rows[fit][::-1]
        best = np.full(n, -1, np.int64)
        best[w[rows]] = rows  # rows are in the order of j; the first is written last
        return best

    def _side_by_side(self, raw: list[bytes]):
        """Token counts of the prefixes of 1, 2, ... bytes of each of ``raw``, taken as whole words, by row;
        ``raw`` falls in length. Within a character they mean nothing."""
        np = self.np
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, start, longest = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, int(sizes[0])
        last, count = np.full((len(raw), longest + 1), -1, np.int32), np.zeros((len(raw), longest + 1), np.int32)
        ended = np.zeros((len(raw), longest), np.int32) if self.end else None
        w = j = node = np.zeros(0, np.int64)
        for i in range(longest):
            n = int(np.searchsorted(-sizes, -i))  # words of more than i bytes
            byte, on = flat[start[:n] + i].astype(np.int64), w < n
            w, j, node = np.append(w[on], np.arange(n)), np.append(j[on], np.full(n, i)), np.append(node[on], np.zeros(n, np.int64))
            node = self.steps.get(node * (_END + 1) + byte[w]).astype(np.int64)
            on = node >= 0
            w, j, node = w[on], j[on], node[on]
            token = self.token_at[node]
            best = self._first(w, j, token, last, n)
            at = np.flatnonzero(best >= 0)
            last[at, i + 1], count[at, i + 1] = token[best[at]], count[at, j[best[at]]] + 1
            if self.end:
                closed = self.steps.get(node * (_END + 1) + _END)
                best = self._first(w, j, np.where(closed >= 0, self.token_at[closed], -1), last, n)
                at = np.flatnonzero(best >= 0)
                ended[at, i] = count[at, j[best[at]]] + 1
        return ended if self.end else count[:, 1:]

    def _word_tables(self, words: list[str]):
        """(token counts of the prefixes of 1, 2, ... characters of each of the distinct words, one
        after the other, and how many each has)."""
        np = self.np
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order, parts, begin = np.argsort(-sizes, kind="stable"), [], 0
        while begin < len(order):
            own = order[begin : begin + max(1, CELLS // int(sizes[order[begin]]))]
            cells = self._side_by_side([raw[i] for i in own])
            parts.append(cells[np.arange(cells.shape[1]) < sizes[own, None]])
            begin += len(own)
        flat, of_bytes = chunks.spread(np.concatenate([np.zeros(0, np.int32), *parts]), sizes[order], np.argsort(order, kind="stable"))
        # A character ends where the next byte is none of its own.
        first = np.frombuffer(b"".join(raw), np.uint8) & 0xC0 != 0x80
        ends = np.append(first[1:], True)[: len(first)]
        return flat[ends], np.fromiter(map(len, words), np.int64, len(words))

    def _piece_tables(self, pieces: list[str]):
        """The same for pieces without white space, which are words one after the other."""
        np = self.np
        split = [self.word.findall(p) for p in pieces]
        number: dict[str, int] = {}
        index = [number.setdefault(w, len(number)) for ws in split for w in ws]
        # "'re" cut short is two words, "'" and "r"; no other kind of word has prefixes of another kind.
        parts = {w: [self.word.findall(w[:i]) for i in range(1, len(w) + 1)] for w in number if len(w) > 1 and w[0] == "'" and len(w) < 4}
        for xs in parts.values():
            for x in (x for one in xs for x in one):
                number.setdefault(x, len(number))
        flat, sizes = self._word_tables(list(number))
        behind = np.cumsum(sizes)
        whole = flat[behind - 1] if len(flat) else flat
        for w, xs in parts.items():
            flat[behind[number[w]] - len(w) : behind[number[w]]] = [sum(int(whole[number[x]]) for x in one) for one in xs]
        index = np.array(index, np.int64)
        counts, n = chunks.spread(flat, sizes, index)
        words = np.fromiter(map(len, split), np.int64, len(split))
        total = np.cumsum(np.append(0, whole[index] if len(index) else [])).astype(np.int64)
        begin = np.cumsum(words) - words
        counts += np.repeat(total[:-1] - np.repeat(total[begin], words), n).astype(np.int32)
        chars = np.append(0, np.cumsum(n))
        return counts, chars[begin + words] - chars[begin]

    # --- texts -----------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The text as the vocabulary's normaliser leaves it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case is taken character by character: a capital sigma at a word's end is no final one.
        for c in self.white:
            if c in text:
                text = text.replace(c, " ")
        while "  " in text:
            text = text.replace("  ", " ")
        return text.replace("Σ", "σ").lower()

    def tables(self, texts: list[str]) -> Iterator:
        """For each text the counts of the prefixes of 0, 1, ... characters of its normal form."""
        for group in chunks.in_groups(texts, GROUP_CHARS):
            yield from self._group([texts[i] for i in group])

    def _group(self, texts: list[str]) -> list:
        # A special string is cut out before anything else.
        cut = [[p for p in self.cut.split(t) if p] if any(s in t for s in self.special) else [t] for t in texts]
        plain = [p for parts in cut for p in parts if p not in self.special]
        made, out = iter(self._plain(plain) if plain else []), []
        for parts in cut:
            own, base = [self.np.zeros(1, self.np.int32)], 0
            for p in parts:
                one = self._special(p) if p in self.special else next(made)
                if len(parts) == 1 and p not in self.special:
                    own = [one]
                    break
                one = one if p in self.special else one[1:]
                own.append(one + base)
                base = int(own[-1][-1]) if len(one) else base
            out.append(own[0] if len(own) == 1 else self.np.concatenate(own).astype(self.np.int32))
        return out

    def _plain(self, texts: list[str]) -> list:
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        lists = pc.split_pattern(pa.array([self.normal(t) for t in texts], pa.string()), " ")
        n, coded = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
        counts, sizes = self._piece_tables(coded.dictionary.to_pylist())
        behind = np.cumsum(sizes)
        whole = np.where(sizes > 0, counts[np.maximum(behind, 1) - 1], 0) if len(counts) else np.zeros(len(sizes), np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts, size = chunks.spread(counts, sizes, index)
        ends, top, last = np.cumsum(size), whole[index], np.cumsum(n)
        before = np.cumsum(top) - top
        before -= np.repeat(before[last - n], n)
        # Each piece stands behind one entry: that of the empty prefix, or of the space before the piece.
        out = np.empty(len(counts) + len(index), np.int32)
        own = np.ones(len(out), bool)
        place = ends - size + np.arange(len(index))
        own[place] = False
        out[place] = before
        out[own] = counts + np.repeat(before, size).astype(np.int32)
        bounds = ends[last - 1] + last
        return np.split(out, bounds[:-1])

    def _special(self, s: str):
        """A special string: cut short it is ordinary text, whole it is one token."""
        one = self._piece_tables([s.lower()])[0].copy()
        one[-1] = 1
        return one


def _tabled(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    """id, n_bytes, and the ``columns`` that ``make`` has for each table of prefix counts."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = docs.schema[id_col].dataType.simpleString()
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(columns).fields]

    def run(batches):
        import pyarrow as pa

        tables = PrefixTables(tokenizer_path)
        for batch in batches:
            rows = [make(counts) for counts in tables.tables([t or "" for t in batch.column(2).to_pylist()])]
            made = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True) if rows else [[] for _ in fields], fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[id_col, "n_bytes", *(name for name, _ in fields)])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")
    return docs.select(id_col, size, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, {columns}")


def prefix_tables(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``, to be stored: id, n_bytes, n_chars (of the normalised text),
    n_tokens, steps, block_counts and block_least.

    Byte i of ``steps`` is the token count of the first i characters less that of the first i - 1 (signed);
    ``block_counts[k]`` is the count of the first k * BLOCK characters and ``block_least[k]`` the smallest
    count of these and the BLOCK - 1 prefixes behind. A null text counts as empty. Rows are independent;
    repeated rows give repeated tables, and other columns are ignored.
    """

    def make(counts):
        import numpy as np

        at = np.arange(0, len(counts), BLOCK)
        return len(counts) - 1, int(counts[-1]), np.diff(counts).astype(np.int8).tobytes(), counts[at], np.minimum.reduceat(counts, at)

    return _tabled(docs, tokenizer_path, id_col, text_col, "n_chars bigint, n_tokens bigint, steps binary, block_counts array<int>, block_least array<int>", make)


def _walk(block: Column, start, merge) -> Column:
    """A fold of ``merge`` over the steps of a block."""
    steps = F.hex(F.substr("steps", block * BLOCK + 1, F.lit(BLOCK - 1)))
    step = lambda k: F.conv(F.substr(steps, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    signed = F.transform(F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 2)), lambda k: k < F.length(steps) / 2), lambda k: F.when(step(k) > 127, step(k) - 256).otherwise(step(k)))
    return F.aggregate(signed, start, merge)


def longest_within(tables: DataFrame, budget: int) -> DataFrame:
    """``tables`` (see prefix_tables) with ``cut_chars``: the length of the longest prefix of the normalised text
    with at most ``budget`` tokens. Counts can fall as a prefix grows, so it is looked for from the end."""
    budget = int(budget)
    block = (F.size("block_least") - F.array_position(F.reverse(F.transform("block_least", lambda c: c <= budget)), F.lit(True))).cast("int")
    first = F.element_at("block_counts", F.col("__block") + 1)
    zero = F.lit(0)
    start = F.struct(first.alias("count"), zero.alias("at"), zero.alias("best"))
    inside = _walk(
        F.col("__block"),
        start,
        lambda s, d: F.struct((s["count"] + d).alias("count"), (s["at"] + 1).alias("at"), F.when(s["count"] + d <= budget, s["at"] + 1).otherwise(s["best"]).alias("best")),
    )["best"]
    found = F.when(F.col("n_tokens") <= budget, F.col("n_chars")).otherwise(F.col("__block").cast("bigint") * BLOCK + inside)
    return tables.withColumn("__block", block).withColumn("cut_chars", found.cast("bigint")).drop("__block")


def count_of_prefix(tables: DataFrame, chars: int) -> DataFrame:
    """``tables`` with ``prefix_tokens``: the token count of the first ``chars`` characters of the normalised text,
    of all of it where it is shorter."""
    chars = int(chars)
    at = F.least(F.col("n_chars"), F.lit(chars))
    block = F.floor(at / BLOCK).cast("int")
    start = F.struct(F.element_at("block_counts", F.col("__block") + 1).alias("count"), (F.col("__block") * BLOCK).cast("bigint").alias("at"))
    count = _walk(F.col("__block"), start, lambda s, d: F.struct((s["count"] + F.when(s["at"] < at, d).otherwise(0)).alias("count"), (s["at"] + 1).alias("at")))["count"]
    return tables.withColumn("__block", block).withColumn("prefix_tokens", count.cast("bigint")).drop("__block")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit, cut_chars, prefix_counts.

    ``prefix_counts[i]`` (with ``store``, else null) is the exact token count of the first i
    characters of the normalised text; ``n_tokens`` is its last entry, and ``cut_chars`` the
    length of the longest prefix of the normalised text with at most ``limit`` tokens. Counts
    can fall as a prefix grows, so the longest is looked for from the end. A null text counts as
    empty: no bytes, no tokens. Rows are independent; other columns are ignored.
    """

    def make(counts):
        n = int(counts[-1])
        return n, n > limit, len(counts) - 1 if n <= limit else int((counts <= limit).nonzero()[0][-1]), counts if store else None

    return _tabled(docs, tokenizer_path, id_col, text_col, "n_tokens bigint, over_limit boolean, cut_chars bigint, prefix_counts array<int>", make)


def cut_at(counts: DataFrame, budget: int) -> DataFrame:
    """From stored tables: the longest prefix of at most ``budget`` tokens, without encoding again."""
    within = F.expr(f"size(prefix_counts) - array_position(reverse(transform(prefix_counts, c -> c <= {int(budget)})), true)")
    return counts.withColumn("cut_chars", within.cast("bigint"))
