"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

Text is encoded the way the vocabulary was built: characters are symbols, and an
agenda of adjacent pairs, best score first and leftmost among equals, says which
pair becomes one symbol next, until no pair is a piece. What is left without a
piece is spelled in byte pieces.

No piece crosses from a letter to a following space mark or over a line break
(checked on the vocabulary), so texts fall into segments that encode on their
own: space marks and the letters after them. Every worker keeps the segments it
has seen, up to a bound, so each is encoded once for most of its occurrences.
Short new segments of a batch are merged together, as rows of symbol numbers:
each step takes from every row its best pair, so that the order inside a
segment is the agenda's; long ones go through an agenda of their own. All new
segments are also encoded and decoded by the sentencepiece library, many in one
text; where one should come out otherwise, the library's pieces are taken.

The model file is opened on the driver and travels as bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logmetrics.llm.frames import without
from logmetrics.llm.words import slices, text_buffers

MARK = "▁"
#: Segments a worker keeps (about 250 bytes each); workers outlive their stage, and so do these.
KEPT = 300_000
#: Bits of an agenda entry that hold a place.
PLACE = 40
MOST = (1 << PLACE) - 1
#: The rank of what makes no piece.
MOST_RANK = np.iinfo(np.int32).max
ADDED = ("piece_ids", "piece_text")
#: Row widths of segments that are merged together; longer ones have their own agenda.
WIDTHS = (4, 8, 12, 16, 24, 32)
#: Segments shown to the library as one text.
SHOWN = 1000
_WORKERS: dict[tuple[bytes, bool], Codec] = {}


class Codec:
    """One vocabulary, with the segments encoded so far."""

    def __init__(self, model: bytes, checked: bool = True) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [
            self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i)
            for i in range(size)
        ]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score.items()}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if self.library.is_byte(i)}
        self.text = [None if s else p for p, s in zip(pieces, special, strict=True)]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end = self.library.eos_id()
        if len(self.bytes) != 256 or any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary needs byte pieces, and no piece may go on over a space or line break")
        start = array("i", self.library.encode("\n")).tobytes()
        self.lead, self.line = start[:4], start[4:]
        self.checked = checked
        #: Segments for which the library's pieces were taken.
        self.mismatches = 0
        self._pair_table()
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Kept segments that decode to something else than themselves.
        self.odd: dict[str, str] = {}

    def merge(self, segment: str) -> list[int]:
        """Piece ids of a segment, by the agenda.

        An entry is the joined piece's rank (best score first, equal scores
        alike) and the place of its left symbol, in one number; it counts only
        if the symbols at its place still make a piece of that rank.
        """
        rank, n = self.rank, len(segment)
        symbols: list[str] = list(segment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [
            found << PLACE | k
            for k in range(n - 1)
            if (found := rank.get(segment[k : k + 2])) is not None
        ]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & MOST
            right = after[left]
            if right >= n or not symbols[left]:
                continue
            joined = symbols[left] + symbols[right]
            if rank.get(joined) != entry >> PLACE:
                continue
            symbols[left], symbols[right] = joined, ""
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                if (found := rank.get(joined + symbols[right])) is not None:
                    heapq.heappush(agenda, found << PLACE | left)
            left = before[left]
            if left >= 0 and (found := rank.get(symbols[left] + joined)) is not None:
                heapq.heappush(agenda, found << PLACE | left)
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                own = self.ids.get(symbol)
                if own is None:
                    ids += [self.bytes[b] for b in symbol.encode()]
                else:
                    ids.append(own)
        return ids

    def _pair_table(self) -> None:
        """Numbers of symbols (pieces, and characters of pieces) and, sorted by key, the pairs that make a piece."""
        number = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                number.setdefault(c, len(self.text) + len(number))
        self.none = max(number.values()) + 1  # of other characters, and beyond a segment's end
        self.symbol = np.full(0x110000, self.none, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.none + 1) + right] = (self.rank[piece], i)
        keys = sorted(pairs)
        self.pair_key = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), MOST_RANK], np.int32)
        self.pair_piece = np.array([*(pairs[k][1] for k in keys), self.none], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; the last place for those that make no piece."""
        key = left.astype(np.int64) * (self.none + 1) + right
        place = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[place] == key, place, len(self.pair_key) - 1).astype(np.int32)

    def _merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled up with ``none``, merged until no pair makes a piece."""
        out, alive = np.full_like(rows, self.none), np.arange(len(rows))
        columns = np.arange(rows.shape[1])[None]
        last = len(self.pair_key) - 1
        pairs = np.full(rows.shape, last, np.int32)  # pair k joins symbols k and k + 1
        pairs[:, :-1] = self._pairs(rows[:, :-1], rows[:, 1:])
        while len(rows):
            ranks = self.pair_rank[pairs]
            at = ranks.argmin(axis=1)  # the leftmost of the best
            every = np.arange(len(rows))
            going = ranks[every, at] < MOST_RANK
            if not going.all():
                out[alive[~going]] = rows[~going]
                rows, pairs, at, alive = rows[going], pairs[going], at[going], alive[going]
                every = every[: len(rows)]
                if not len(rows):
                    break
            joined = self.pair_piece[pairs[every, at]]
            shift = np.minimum(columns + (columns > at[:, None]), rows.shape[1] - 1)
            rows, pairs = np.take_along_axis(rows, shift, 1), np.take_along_axis(pairs, shift, 1)
            rows[:, -1], pairs[:, -1] = self.none, last
            rows[every, at] = joined
            pairs[every, at] = self._pairs(joined, rows[every, np.minimum(at + 1, rows.shape[1] - 1)])
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            pairs[inner, before] = self._pairs(rows[inner, before], joined[inner])
        return out

    def merge_all(self, segments: list[str]) -> tuple[list[bytes], list[int]]:
        """Piece ids of many segments, each as 32-bit numbers; which of them may hold byte pieces."""
        found: list[bytes] = [b""] * len(segments)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(s) for s in segments], np.int64)
        symbols, starts = self.symbol[codes], np.cumsum(lengths) - lengths
        odd = np.zeros(len(codes) + 1, np.int64)
        np.cumsum((symbols >= len(self.text)), out=odd[1:])  # characters that are no piece are spelled in bytes
        spelled = odd[starts + lengths] > odd[starts]
        alone = spelled | (lengths > WIDTHS[-1])
        for k in np.flatnonzero(alone).tolist():
            found[k] = array("i", self.merge(segments[k])).tobytes()
        for low, width in zip((0, *WIDTHS[:-1]), WIDTHS, strict=True):
            own = np.flatnonzero((lengths > low) & (lengths <= width) & ~alone)
            if not len(own):
                continue
            columns = np.arange(width)[None]
            place = np.minimum(starts[own, None] + columns, len(symbols) - 1)
            rows = np.where(columns < lengths[own, None], symbols[place], np.int32(self.none))
            merged = self._merge_rows(rows.astype(np.int32))
            held = merged != self.none
            ends = np.cumsum(held.sum(axis=1)) * 4
            data, at = merged[held].tobytes(), 0
            for k, end in zip(own.tolist(), ends.tolist(), strict=True):
                found[k], at = data[at:end], end
        return found, np.flatnonzero(spelled).tolist()

    def learn(self, segments: list[str]) -> None:
        """Encode new segments, check them with the library, and keep them."""
        ours, spelled = self.merge_all(segments)
        texts = [s.replace(MARK, " ") for s in segments]
        plain = list(texts)
        for k in spelled:  # only bytes can read as something else
            texts[k] = self.decode(np.frombuffer(ours[k], np.int32).tolist(), whole=False)
        if self.checked:
            for at in range(0, len(segments), SHOWN):
                part = slice(at, at + SHOWN)
                if not self._alike(segments[part], ours[part], texts[part]):
                    for k in range(at, min(at + SHOWN, len(segments))):
                        ours[k], texts[k] = self._library(segments[k], ours[k], texts[k])
        self.kept.update(zip(segments, ours, strict=True))
        if texts != plain:
            self.odd.update((s, t) for s, t, p in zip(segments, texts, plain, strict=True) if t != p)

    def _alike(self, segments: list[str], ours: list[bytes], texts: list[str]) -> bool:
        """Whether the library encodes and decodes the segments, as lines of one text, as we do.

        It puts a space mark before any text; each segment follows a line break.
        """
        theirs = self.library.encode("\n" + "\n".join(segments).replace(MARK, " "))
        return (
            array("i", theirs).tobytes() == self.lead + self.line + self.line.join(ours)
            and self.library.decode(theirs) == "\n" + "\n".join(texts)
        )

    def _library(self, segment: str, ids: bytes, text: str) -> tuple[bytes, str]:
        """The library's pieces and text of one segment, counted where they are not ours.

        The mark before any text is a segment's own first one; a segment without
        marks is shown after a line break. What is all blank stays ours: the
        library cannot be shown it alone.
        """
        shown = segment[1:].replace(MARK, " ") if segment[:1] == MARK else "\n" + segment
        skip, lead = (0, 1) if segment[:1] == MARK else (2, 0)
        if not shown:
            return ids, text
        theirs = self.library.encode(shown)
        back = (" " if lead else "") + self.library.decode(theirs)[1 - lead :]
        other = array("i", theirs[skip:]).tobytes()
        self.mismatches += other != ids or back != text
        return other, back

    #: A line's segments: space marks with the letters after them; letters at a line's start.
    _segment = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def cut(self, text: str) -> list[str]:
        """Segments of a text, with the mark that stands before any text."""
        return self._segment.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Each text's ids (32-bit, with the end id) and what they decode to.

        Segments are kept in two generations: when the younger is full it
        becomes the older one, and what is met again comes back from there, so
        frequent segments stay.
        """
        cuts = [self.cut(t) for t in texts]
        wanted = set().union(*cuts)
        if len(self.kept) + len(wanted - self.kept.keys()) > KEPT // 2:
            self.older = {s: ids for s, ids in self.kept.items() if s not in self.odd}
            self.kept, self.odd = {}, {}
        missing = wanted - self.kept.keys()
        again = missing & self.older.keys()
        self.kept.update((s, self.older[s]) for s in again)
        self.learn(list(missing - again))
        end, kept, odd = array("i", [self.end]).tobytes(), self.kept, self.odd
        plain = cuts if not odd else [[odd.get(s, s) for s in c] for c in cuts]
        ids = [b"".join([kept[s] for s in c]) + end for c in cuts]
        return ids, ["".join(c)[1:].replace(MARK, " ") for c in plain]

    def decode(self, ids: list[int], whole: bool = True) -> str:
        """The text of piece ids: bytes joined as UTF-8, control ids left out.

        ``whole`` drops the space mark that stands before any text.
        """
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i >= 0 and self.text[i] is not None:
                piece = self.text[i].replace(MARK, " ")
                out.append(piece[1:] if whole and not out and piece[:1] == " " else piece)
        return "".join(out)


def _codec(model: bytes, checked: bool) -> Codec:
    """The worker's codec, kept from task to task."""
    key = (hashlib.sha256(model).digest(), checked)
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Codec(model, checked)
    return _WORKERS[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(
    docs: DataFrame, text_col: str = "text", model: str | None = None, checked: bool = True, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``piece_ids`` (an end id last) and ``piece_text``, what they decode to.

    ``model`` is the path of a vocabulary file on the driver. A null or empty
    text gives the end id alone and ''; space marks in a text count as spaces,
    as in the library; an empty table gives an empty one; columns named like the
    added ones are replaced. ``keep_text=False`` leaves the text column out.
    """
    with open(model or default_model(), "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = without(docs, *ADDED)
    text_at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    schema = T.StructType(
        [docs.schema.fields[k] for k in kept]
        + [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_text", T.StringType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, checked)
        for batch in batches:
            _, offsets = text_buffers(batch.column(text_at))
            for begin, end in slices(offsets):
                part = batch.slice(begin, end - begin)
                ids, texts = codec.encode([t or "" for t in part.column(text_at).to_pylist()])
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), lists, pa.array(texts, pa.string())],
                    [*(part.schema.names[k] for k in kept), *ADDED],
                )

    return docs.mapInArrow(encode, schema)


def decode_pieces(df: DataFrame, ids_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """``df`` with ``piece_text`` decoded from piece ids alone; null ids give ''."""
    with open(model or default_model(), "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())
    df = without(df, "piece_text")
    ids_at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField("piece_text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, False)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "piece_text"]
            )

    return df.mapInArrow(decode, schema)
