"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

Documents are range-partitioned by id, encoded after the shuffle and written in ascending
order, one file for each range, each row with its place in the file. The reader needs one
small column to add up the files before, and prunes stripes and row groups by the id's
statistics and Bloom filters for lookups.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .shared import LAST_ID

#: A word of Latin letters with one mark behind it: the pre-tokenizer cuts before the mark.
_MARKED, _MARKS = r"^[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]$", ".,;:!?"
_WHITE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Pieces that the library encodes in one text.
AT_ONCE = 2_000
#: Bytes of pieces and of their ids that an encoder keeps from one group to the next.
KNOWN_BYTES = 12_000_000
SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 2_000


class LibraryEncoder:
    """Encodes texts with a tokenizers file, each distinct piece of a group of texts once.

    Pieces of groups before are known with their ids, up to KNOWN_BYTES; beyond these the pieces of the newest
    group alone are, if they are no more. So memory is that of a group.
    """

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        marks = self._each(list(_MARKS))
        self.mark = dict(zip(_MARKS, marks[0].tolist(), strict=True))
        self.nothing = self.known = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]):
        """(ids of the texts one after the other, how many each has)."""
        import numpy as np

        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.int32, int(n.sum())), n

    def _spaced(self, pieces):
        """The same for an Arrow array of pieces, each behind a space. Only a piece's first token
        holds a space, so many pieces are one text for the library."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.or_(pc.equal(pieces, ""), pc.match_substring_regex(pieces, _WHITE)).to_numpy(zero_copy_only=False)
        for s in self.special:
            odd |= pc.match_substring(pieces, s.strip()).to_numpy(zero_copy_only=False)
        plain = pieces.filter(pa.array(~odd)).to_pylist()
        parts = [plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)]
        flat, sizes = [], []
        for i in range(0, len(parts), 16):
            some = parts[i : i + 16]
            for part, e in zip(some, self.library.encode_batch_fast([" " + " ".join(p) for p in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) != len(part):
                    ids, n = self._each([" " + p for p in part])
                else:
                    n = np.diff(np.append(starts, len(ids)))
                flat.append(ids)
                sizes.append(n)
        whole, n = self._each([" " + p for p in pieces.filter(pa.array(odd)).to_pylist()])
        flat, sizes = np.concatenate([*flat, whole]), np.concatenate([*sizes, n]).astype(np.int64)
        # In the order of the pieces again.
        place = np.empty(len(odd), np.int64)
        place[~odd] = np.arange(len(plain))
        place[odd] = len(plain) + np.arange(int(odd.sum()))
        return chunks.spread(flat, sizes, place)

    def _remembered(self, pieces):
        """``_spaced`` of distinct pieces, of which the library gets those alone that are not known."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, flat, sizes = self.known
        index = pc.fill_null(pc.index_in(pieces, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = index < 0
        fresh = pieces.filter(pa.array(new))
        ids, n = self._spaced(fresh)
        index[new] = len(sizes) + np.arange(len(n))
        flat, sizes = np.concatenate([flat, ids]), np.concatenate([sizes, n])
        out, each = chunks.spread(flat, sizes, index)
        # All pieces, or this group's, or none: the first that are not too large.
        size = lambda k: k[0].nbytes + k[1].nbytes + k[2].nbytes
        kept = ((pa.concat_arrays([known, fresh]), flat, sizes), (pieces, out, each), self.nothing)
        self.known = next(k for k in kept if size(k) <= KNOWN_BYTES or k is self.nothing)
        return out, each

    def _distinct(self, pieces):
        """The ids of distinct pieces, each behind a space; a mark behind a word is a token of its own."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.match_substring_regex(pieces, _MARKED)
        cores = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        marked = marked.to_numpy(zero_copy_only=False)
        ids, n = self._remembered(cores.dictionary)
        core = cores.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        last = pc.index_in(pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1), value_set=pa.array(list(_MARKS))).to_numpy(zero_copy_only=False)
        # The marks stand behind the cores' ids as values of one id each.
        flat = np.concatenate([ids, np.array([self.mark[m] for m in _MARKS], np.int32)])
        sizes = np.concatenate([n, np.ones(len(_MARKS), np.int64)])
        index = np.empty(len(core) + int(marked.sum()), np.int64)
        at = np.arange(len(core)) + np.cumsum(marked) - marked
        index[at] = core
        index[at[marked] + 1] = len(n) + last.astype(np.int64)
        out, each = chunks.spread(flat, sizes, index)
        return out, np.add.reduceat(each, at) if len(at) else each

    def encode(self, texts):
        """For groups of the Arrow array ``texts`` (no nulls): the ids of the group's texts one after the
        other, and how many each text has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        length = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for group in chunks.spans(length):
            part, whole = texts.slice(group.start, len(group)), np.flatnonzero(special[group.start : group.stop])
            if len(whole):
                # A text with a special string is encoded whole: the library cuts it out first.
                held = [part[int(i)].as_py() for i in whole]
                part = pc.if_else(pa.array(special[group.start : group.stop]), "", part)
            pieces, sizes = chunks.split_all(part)
            behind = np.cumsum(sizes)
            # A text's first piece has no space before it; that of a whole text is all of it.
            first = behind - sizes
            firsts = pieces.take(pa.array(first)).to_pylist()
            if len(whole):
                for i, t in zip(whole, held, strict=True):
                    firsts[int(i)] = t
            coded = pieces.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            del pieces
            ids, n = self._distinct(coded.dictionary)
            own, m = self._each(firsts)
            index[first] = len(n) + np.arange(len(first))
            out, each = chunks.spread(np.concatenate([ids, own]), np.concatenate([n, m]), index)
            # Nothing of this group but its ids is held while the next one is made.
            del part, coded, index, ids, n, own, m, firsts
            yield out, np.add.reduceat(each, first)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    """The encoder of a Python process: its next task knows the pieces of the one before."""
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write them to ORC files at ``path``, in ascending order of the id.

    Each document ends with ``end_id``; a null text counts as empty and has that id alone. Null
    ids come last; rows that share an id are ordered by a hash of their text. Other columns
    are not written. An empty table gives a folder without rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = (F.coalesce("doc_id", F.lit(LAST_ID)), F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        code, start, part = encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for ids, n in code.encode(batch.column(1)):
                # Room for the end id behind each document's own.
                n = n + 1
                behind = np.cumsum(n)
                out = np.full(int(behind[-1]), end_id, np.int32)
                own = np.ones(len(out), bool)
                own[behind - 1] = False
                out[own] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], behind]).astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(start + behind - n), pa.array(n), lists],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(behind[-1])
                at += len(n)

    (
        dealt.mapInArrow(run, SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids.

    With ``doc_ids``, the filter goes to the ORC reader, which skips stripes and row groups.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each file: the window over all of them is small at any size.
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    wanted = rows if doc_ids is None else rows.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))
    return wanted.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """Each document's doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(3)
            values, offsets = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), np.uint32)).cast("B"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            count = pa.array((offsets[1:] - offsets[:-1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), count, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
