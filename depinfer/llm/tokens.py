"""Whole-text tokenisation on executors: distinct chunks are encoded by the tokenizers library, many to a call."""

from __future__ import annotations

import re

from pyspark import Broadcast
from pyspark.sql import SparkSession

from depinfer.llm.common import give_back, process_cache, ship

#: Characters of text that are encoded together; a longer text is a slice of its own.
SLICE_CHARS = 20_000_000
#: Chunks in one text for the library, and texts in one call.
JOINED, CALL = 1024, 32
#: Ids that are put together at a time.
GATHER = 1 << 20

_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_TWO_SPACES = rf"[{_SPACE}]{{2}}"
_NO_SPACE = rf"^[^{_SPACE}]+$"
_CHUNK_STARTS = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _gather(store, starts, sizes):
    """Pieces of ``store``, one after another."""
    import numpy as np

    done = np.cumsum(sizes)
    out = np.empty(int(done[-1]) if len(done) else 0, np.uint32)
    edges = [0, *(np.flatnonzero(np.diff(done // GATHER)) + 1).tolist(), len(done)]
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            first = int(done[a] - sizes[a])
            out[first : int(done[b - 1])] = store[np.arange(first, int(done[b - 1])) + np.repeat(starts[a:b] - (done[a:b] - sizes[a:b]), sizes[a:b])]
    return out


class Encoder:
    """Byte-level BPE ids of whole texts.

    The pre-tokenizer starts a new piece at a single space or line feed between
    two characters that are not white space.  So the chunks between such places
    can be encoded on their own, once for each distinct chunk of a slice, and
    many chunks in one text: cut again where a token begins with a space, as a
    chunk's first token does and no other.  Arrow splits the texts and finds the
    distinct chunks, NumPy puts the ids together.
    """

    def __init__(self, json_text: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.encode_special_tokens = True
        #: Which tokens begin with a space (written as U+0120 in the vocabulary).
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True

    def _batch(self, texts: list[str]) -> list:
        """The ids of each text."""
        import numpy as np

        out = []
        # The library's results are large: a few thousand at a time.
        for at in range(0, len(texts), 8192):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + 8192], add_special_tokens=False)]
        return out

    def _ids_of(self, chunks):
        """``(store, starts, sizes)`` of a string array of chunks that follow a space, or begin with a line feed."""
        import numpy as np
        import pyarrow.compute as pc

        joined = pc.match_substring_regex(chunks, _NO_SPACE).to_numpy(zero_copy_only=False)
        at, others = np.flatnonzero(joined), np.flatnonzero(~joined)
        words, stored, sizes = chunks.take(at).to_pylist(), [], np.zeros(len(chunks), np.int64)
        for a in range(0, len(words), JOINED * CALL):
            parts = [words[i : i + JOINED] for i in range(a, min(a + JOINED * CALL, len(words)), JOINED)]
            for k, e in enumerate(self.tokenizer.encode_batch_fast([" " + " ".join(x) for x in parts], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                edges = np.flatnonzero(self.opens[ids])
                if len(edges) != len(parts[k]) or len(edges) and edges[0]:
                    each = self._batch([" " + w for w in parts[k]])
                    ids, edges = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
                first = a + k * JOINED
                sizes[at[first : first + len(edges)]] = np.diff(np.append(edges, len(ids)))
                stored.append(ids)
        each = self._batch([w if w[:1] == "\n" else " " + w for w in chunks.take(others).to_pylist()])
        sizes[others] = np.fromiter(map(len, each), np.int64, len(each))
        order, starts = np.concatenate([at, others]), np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([*stored, *each, np.empty(0, np.uint32)]), starts, sizes

    def encode(self, texts, end_id: int):
        """``(offsets, ids)`` of a string array without nulls; each text's ids end with ``end_id``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string())
        unsafe = pc.or_(pc.match_substring_regex(texts, _TWO_SPACES), pc.starts_with(texts, "\n"))
        plain = pc.if_else(unsafe, "", texts)
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat, bounds = lists.flatten(), np.diff(lists.offsets.to_numpy())
        coded = flat.dictionary_encode()
        first = np.cumsum(bounds) - bounds
        index = coded.indices.to_numpy().astype(np.int64)
        store, starts, sizes = self._ids_of(coded.dictionary)
        # A text's first chunk follows no space, and texts that can't be split go whole, or by safe places: both get entries of their own.
        index[first] = len(sizes) + np.arange(len(first))
        own = self._batch(flat.take(pa.array(first)).to_pylist())
        for i in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)):
            head, *later = _CHUNK_STARTS.split(texts[int(i)].as_py())
            own[i] = np.concatenate([*self._batch([head]), _gather(*self._ids_of(pa.array([w[1:] if w[0] == " " else w for w in later], pa.large_string())))])
        own.append(np.array([end_id], np.uint32))
        own_sizes = np.fromiter(map(len, own), np.int64, len(own))
        starts = np.concatenate([starts, len(store) + np.cumsum(own_sizes) - own_sizes])
        store, sizes = np.concatenate([store, *own]), np.concatenate([sizes, own_sizes])
        ends = np.cumsum(bounds)
        index = np.insert(index, ends, len(sizes) - 1)
        sizes = sizes[index]
        done = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate([[0], done[ends + np.arange(len(ends)) + 1]]).astype(np.int64), _gather(store, starts[index], sizes)

    def slices(self, batches):
        """The record batches, which have a ``text`` column, cut and put together to slices of about ``SLICE_CHARS``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts, held = [], 0

        def whole():
            table = pa.Table.from_batches(parts).combine_chunks()
            return table.to_batches()[0]

        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (held + np.cumsum(size)) // SLICE_CHARS
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    parts.append(batch.slice(a, b - a))
                    held += int(size[a:b].sum())
                    if held >= SLICE_CHARS:
                        yield whole()
                        parts, held = [], 0
                        give_back()
        if parts:
            yield whole()
            parts = []
        give_back()


def encoder(json_text: Broadcast) -> Encoder:
    """The worker process's encoder."""
    held = process_cache("encoders")
    key = hash(json_text.value)
    if key not in held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held[key] = Encoder(json_text.value)
    return held[key]


def broadcast_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text; its size is that of the file (1.5 MB), whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ship(__name__)
