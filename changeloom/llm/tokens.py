"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

The vocabulary is a byte-level BPE: its pre-tokenizer cuts a text into pieces
and the model works inside each piece.  Pieces repeat, so their ids are
remembered, up to a fixed number of pieces in each Python worker; a piece that
is not remembered goes through the library's model.  Texts with characters
outside a plain Latin set go through the whole tokenizer, since other Unicode
versions may cut them differently.  All three ways give the library's ids.

Memory is bounded by bytes: the tables stop growing at a fixed size, and texts
are worked on in slices of about ``SLICE_CHARS``.  A longer text is cut before
single spaces between words, where the pre-tokenizer always cuts; a text without
such a place is one slice.
"""

from __future__ import annotations

import re

#: Fixed values of the vocabulary's pre-tokenizer, for plain Latin texts.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡«»¿À-ɏ‐-‧]*")
#: White space other than single spaces and line ends between words.
_OTHER_SPACES = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: A place where every text can be cut: the space belongs to the word behind it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries that a worker remembers, about 60 bytes each for chunks and 250 for pieces.
REMEMBERED_PIECES, REMEMBERED_CHUNKS = 50_000, 1_000_000
#: Chunks wait in a list of new ones, at most so many, before they join the table.
NEW_CHUNKS = 50_000
SLICE_CHARS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class _Pieces(dict):
    """Ids of pre-tokenizer pieces, little-endian."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) < REMEMBERED_PIECES:
            self[piece] = ids
        return ids


class _Chunks:
    """Ids of what stands between spaces, by the hash of the chunk.

    The space before a chunk is part of it, unless the chunk begins a line
    (then with its line end) or a text (then with a zero character).  The table
    is a sorted array of hashes with the places of their ids in one long array.
    """

    def __init__(self, pieces: _Pieces):
        import numpy as np

        self.pieces = pieces
        self.keys, self.begins, self.widths = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, "<u4")
        self.new: list[tuple] = []
        self.waiting = 0

    def encode(self, chunk: str) -> bytes:
        text = chunk if chunk[:1] == "\n" else chunk[1:] if chunk[:1] == "\0" else f" {chunk}"
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))

    def look_up(self, chunks):
        """(ids, begins, widths): the ids of some distinct chunks (an Arrow array), and where those of each stand."""
        import numpy as np
        import pyarrow as pa

        keys = _chunk_hashes(chunks)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        at = at[known]
        begins, widths = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
        new = np.flatnonzero(~known)
        raw = [*map(self.encode, chunks.take(pa.array(new)).to_pylist())]
        widths[new] = np.fromiter(map(len, raw), np.int32, len(raw)) >> 2
        made = np.frombuffer(b"".join(raw), "<u4")
        begins[new] = np.cumsum(widths[new]) - widths[new]
        widths[known] = self.widths[at]
        old_ends = np.cumsum(widths[known])
        begins[known] = len(made) + old_ends - widths[known]
        old = self.ids[_runs(self.begins[at], widths[known])]
        if len(self.keys) + self.waiting + len(new) <= REMEMBERED_CHUNKS:
            self.new.append((keys[new], widths[new], made))
            self.waiting += len(new)
            if self.waiting >= NEW_CHUNKS:
                self.settle()
        return np.concatenate([made, old]), begins, widths

    def settle(self) -> None:
        """Move the new chunks into the table."""
        import numpy as np

        keys, first = np.unique(np.concatenate([x[0] for x in self.new]), return_index=True)
        widths, ids = np.concatenate([x[1] for x in self.new]), np.concatenate([x[2] for x in self.new])
        begins = (len(self.ids) + np.cumsum(widths) - widths).astype(np.int32)
        place = np.searchsorted(self.keys, keys)
        self.begins = np.insert(self.begins, place, begins[first])
        self.widths = np.insert(self.widths, place, widths[first])
        self.keys = np.insert(self.keys, place, keys)
        self.ids = np.concatenate([self.ids, ids])
        self.new, self.waiting = [], 0


def _runs(begins, widths):
    """The positions of runs that begin at ``begins`` and are ``widths`` long, one after the other."""
    import numpy as np

    ends = np.cumsum(widths, dtype=np.int32)
    return np.repeat(begins - (ends - widths), widths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def _chunk_hashes(chunks):
    """64-bit hashes of an Arrow array of large strings."""
    import numpy as np

    from .shingles import _tables, mixed

    bounds = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    first = int(bounds[0])
    data = np.frombuffer(chunks.buffers()[2], np.uint8)[first : int(bounds[-1])]
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    starts, ends = bounds[:-1] - first, bounds[1:] - first
    return mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def _simple(text: str) -> bool:
    """Whether chunks between spaces can be encoded one by one."""
    return bool(text) and text[0] != "\n" and text[-1] not in " \n" and not any(x in text for x in _OTHER_SPACES)


def slices(text: str) -> list[str]:
    """``text`` in slices that can be encoded one by one."""
    out, at = [], 0
    while len(text) - at > SLICE_CHARS and (cut := _CUT.search(text, at + SLICE_CHARS)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers, without special tokens."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.pieces = _Pieces(self.tokenizer.model)
        self.chunks = _Chunks(self.pieces)

    def whole(self, text: str) -> bytes:
        """The library's own encoding."""
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self._one, slices(text)))

    def _one(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [slices(text) for text in texts]
        parts = [part for own in cut for part in own]
        done: list[bytes] = [b""] * len(parts)
        todo, size = [], 0
        for k, part in enumerate(parts):
            if not _PLAIN.fullmatch(part):
                done[k] = self.whole(part)
            elif _simple(part):
                todo.append(k)
                size += len(part)
            else:
                done[k] = self._one(part)
            if todo and (size >= SLICE_CHARS or k == len(parts) - 1):
                for one, ids in zip(todo, self._gathered([parts[one] for one in todo]), strict=True):
                    done[one] = ids
                todo, size = [], 0
        found = iter(done)
        return [next(found) if len(own) == 1 else b"".join(next(found) for _ in own) for own in cut]

    def _gathered(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pa.array(["\0" + x.replace("\n", " \n") for x in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        flat, begins, widths = self.chunks.look_up(coded.dictionary)
        chunk = coded.indices.to_numpy()
        width = widths[chunk]
        raw = flat[_runs(begins[chunk], width)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[lists.offsets.to_numpy()]
        return [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def sliced(batch):
    """Slices of a batch whose texts (column 1) have about SLICE_CHARS bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_CHARS, side="right")))
        yield batch.slice(at, end - at)
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary in a process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
