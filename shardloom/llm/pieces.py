"""Byte-pair pieces of whole texts by distinct pre-token groups, vectorised with Arrow.

A *unit* is a stretch of text whose pieces do not depend on what surrounds it.
In texts without runs of white space that hold a blank, every blank starts a
new pre-token, so the parts between blanks (each with the blank before it) are
units.  Other texts, and those with a long stretch without a blank, are cut into
the library's own pre-tokens, and texts with added special tokens are given to
the library whole.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space next to a blank: there a blank need not start a pre-token.
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = f"{_SPACE} | {_SPACE}"
#: A stretch that is too long to be a unit of its own.
LONG = r"[^ ]{128}"
#: Characters whose class is the same in every Unicode version that the libraries use.
SETTLED = r"^[\x00-\x{24f}\x{370}-\x{373}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{48a}-\x{513}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20b5}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]*$"
_SETTLED = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SETTLED)[:-1] + r"\Z")
#: Bytes of text worked on at once.
CHUNK_BYTES = 24 << 20


def text_chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches (with a string column ``text``) at ``size`` bytes of text; a longer text is a chunk of its own."""
    for batch in batches:
        text = batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Pieces:
    """Encoder of one vocabulary: ``model`` is a tokenizers JSON file, ``ranks`` the same vocabulary for tiktoken.

    Without ``ranks`` the units go to the tokenizers library, which is slower.
    """

    def __init__(self, model: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        with open(model, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        self.special = "|".join(re.escape(t["content"]) for t in added) or None
        self.fast = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            self.piece_bytes = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for piece, number in table.items():
                self.piece_bytes[number] = len(piece)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text as the library gives them by default."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, int, dict[int, str]]:
        """Of texts without nulls: owner (text) and number of every unit in order, the distinct units, how many of these can be joined, and the texts that must be encoded whole."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        hard = pc.or_(pc.match_substring_regex(texts, f"{RUNS}|{LONG}"), pc.invert(pc.match_substring_regex(texts, SETTLED)))
        whole: dict[int, str] = {}
        if self.special:
            marked = pc.match_substring_regex(texts, self.special)
            if pc.any(marked).as_py():
                for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)):
                    whole[int(k)] = texts[int(k)].as_py()
                texts = pc.if_else(marked, "", texts)
                hard = pc.and_not(hard, marked)
        own: list[tuple[int, list[str]]] = []
        if pc.any(hard).as_py():
            for k in np.flatnonzero(hard.to_numpy(zero_copy_only=False)):
                text = texts[int(k)].as_py()
                own.append((int(k), [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]))
            texts = pc.if_else(hard, "", texts)
        parts = pc.split_pattern(texts, " ")
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(parts)
        owner = np.repeat(np.arange(len(size), dtype=np.int64), size)
        is_first = np.zeros(len(flat), dtype=bool)
        is_first[np.cumsum(size) - size] = True
        coded = flat.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spaced = pc.binary_join_element_wise(" ", coded.dictionary, "")
        firsts = pc.take(flat, pa.array(np.flatnonzero(is_first))).dictionary_encode()
        number[is_first] = len(spaced) + firsts.indices.to_numpy(zero_copy_only=False)
        distinct = [spaced, firsts.dictionary]
        if own:
            extra = pa.array([u for _, us in own for u in us], pa.string()).dictionary_encode()
            owner = np.concatenate([owner, np.repeat([k for k, _ in own], [len(us) for _, us in own]).astype(np.int64)])
            number = np.concatenate([number, len(spaced) + len(firsts.dictionary) + extra.indices.to_numpy(zero_copy_only=False)])
            distinct.append(extra.dictionary)
            order = np.argsort(owner, kind="stable")
            owner, number = owner[order], number[order]
        return owner, number, pa.concat_arrays([d.cast(pa.string()) for d in distinct]), len(spaced), whole

    def encode(self, units: pa.Array, joinable: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after another, and the number of ids of each unit.

        The first ``joinable`` units start with a blank and hold no other white
        space next to one, so they are encoded as one text: no pre-token
        crosses a seam, and the pieces' bytes tell the units apart.
        """
        if self.fast is None:
            found = [e.ids for e in self.library.encode_batch(units.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        sizes = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        alone = np.arange(len(units)) >= joinable
        alone |= sizes == 1
        where = np.flatnonzero(~alone)
        joined = np.asarray(self.fast.encode_ordinary(_joined(units.take(pa.array(where)))), dtype=np.uint32)
        stop = np.searchsorted(np.cumsum(self.piece_bytes[joined]), np.cumsum(sizes[where]), side="left") + (len(where) > 0)
        counts = np.zeros(len(units), dtype=np.int64)
        counts[where] = np.diff(stop, prepend=0)
        rest = np.flatnonzero(alone)
        singles = [self._one(u) for u in units.take(pa.array(rest)).to_pylist()]
        counts[rest] = [len(x) for x in singles]
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        out[np.repeat(starts[where] - (stop - counts[where]), counts[where]) + np.arange(len(joined))] = joined
        for k, ids in zip(rest, singles):
            out[starts[k] : starts[k] + len(ids)] = ids
        return out, counts

    def _one(self, unit: str) -> np.ndarray:
        return np.asarray(self.fast.encode_ordinary(unit), dtype=np.uint32) if _SETTLED.match(unit) else self.whole(unit)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without nulls, one text after another, and the number of ids of each text."""
        owner, number, distinct, joinable, whole = self.units(texts)
        of_units, count = self.encode(distinct, joinable)
        start = np.cumsum(count) - count
        long = count[number]
        total = np.bincount(owner, weights=long, minlength=len(texts)).astype(np.int64)
        flat = of_units[np.repeat(start[number] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))]
        if not whole:
            return flat, total
        bounds = np.cumsum(total)
        split = np.split(flat, bounds[:-1])
        for k, text in whole.items():
            split[k] = self.whole(text)
        return np.concatenate(split), np.fromiter(map(len, split), dtype=np.int64, count=len(split))


def _joined(strings: pa.Array) -> str:
    """All strings of an array as one; its data buffer holds just that."""
    if not len(strings):
        return ""
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return data[int(bounds[0]) : int(bounds[-1])].to_pybytes().decode() if data else ""


@cache
def pieces(model: str, ranks: str | None = None) -> Pieces:
    """One encoder per Python worker and vocabulary."""
    return Pieces(model, ranks)
