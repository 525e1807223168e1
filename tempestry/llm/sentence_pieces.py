"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

The agenda merges the pair whose union is the best-scored piece, leftmost first among equals, until no pair is
a piece; symbols that are no piece become their UTF-8 bytes' pieces, or the unknown piece. Where no piece of the
vocabulary has a space mark after another character, no merge ever crosses the beginning of a run of space
marks, so texts are encoded by such segments and recurring segments are remembered. New segments of one length run their
agendas side by side: each step finds the best pair of every segment, merges it and looks up its two new neighbours in
a table of mergeable pairs. Every new segment of an Arrow batch is checked against the sentencepiece library; a difference
raises an error.

Null texts count as empty and give no ids. Ids come without begin or end marks and without sampling. Repeated rows
get equal results and an empty table gives no rows. Very long texts are read whole; a segment that is
long itself runs a heap. Ties between equally scored pairs go to the leftmost.
"""

import hashlib
import heapq
from functools import cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tempestry.llm.common import text_function

SPACE = "▁"
SEGMENT_LIMIT = 500_000
#: Longer segments use a heap.
SHORT = 48
#: So many segments of one length at least, and at most at a time, run their agendas together.
FEW, SIDE_BY_SIDE = 8, 4096
NEVER = float("inf")
#: Texts whose new segments are learned together.
TEXTS = 1024


class PieceEncoder:
    def __init__(self, path):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = range(self.library.get_piece_size())
        self.byte_ids, self.ids, self.scores = {}, {}, {}
        for i in vocabulary:
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = -self.library.get_score(i)
        self.unknown = self.library.unk_id()
        #: Decimal ids.
        self.digits = list(map(str, vocabulary))
        self.separable = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.segments, self.older = {}, {}
        self.build_pairs()

    def build_pairs(self):
        """Symbols by number: pieces first, then characters that only occur inside pieces; and all pairs of symbols that
        join to a piece, as sorted numbers with their pieces and scores."""
        letters = sorted(set().union(*self.ids) - self.ids.keys())
        self.pieces_end = self.library.get_piece_size()
        number = self.ids | {c: self.pieces_end + i for i, c in enumerate(letters)}
        self.symbol_text = {i: c for c, i in number.items()}
        # The last symbol stands for all other characters, which never join.
        self.other = self.pieces_end + len(letters)
        self.symbol_count = self.other + 1
        self.letter_symbol = np.full(0x110000, self.other, dtype=np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.letter_symbol[ord(c)] = i
        found = []
        for piece, own in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * self.symbol_count + right, own, self.scores[piece]))
        found.sort()
        self.pair_keys = np.array([key for key, _, _ in found] or [-1], dtype=np.int64)
        self.pair_piece = np.array([own for _, own, _ in found] or [0], dtype=np.int64)
        self.pair_score = np.array([score for _, _, score in found] or [NEVER], dtype=np.float64)

    def joined(self, left, right):
        """(score, piece) of pairs of symbols; the score of a pair that is no piece is NEVER."""
        keys = left * self.symbol_count + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_score[at], NEVER), self.pair_piece[at]

    def agendas(self, texts):
        """Ids of many segments, by segment."""
        found, by_length = {}, {}
        for text in texts:
            by_length.setdefault(len(text), []).append(text)
        for length, group in by_length.items():
            if length > SHORT or len(group) < FEW:
                found.update((text, self.agenda(text)) for text in group)
                continue
            for i in range(0, len(group), SIDE_BY_SIDE):
                self.agendas_alike(group[i : i + SIDE_BY_SIDE], length, found)
        return found

    def agendas_alike(self, group, length, found):
        """Runs the agendas of segments of one length together: with each step every one still open is a symbol shorter."""
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(group), length)
        who, symbols = np.arange(len(group)), self.letter_symbol[codes]
        scores, pieces = self.joined(symbols[:, :-1], symbols[:, 1:])
        while len(who):
            width = scores.shape[1]
            rows = np.arange(len(who))
            best = scores.argmin(axis=1) if width else np.zeros(len(who), dtype=np.int64)
            is_open = scores[rows, best] < NEVER if width else np.zeros(len(who), dtype=bool)
            if not is_open.all():
                done = [group[i] for i in who[~is_open].tolist()]
                ended = symbols[~is_open]
                found.update(zip(done, ended.tolist()))
                for i in np.flatnonzero((ended >= self.pieces_end).any(axis=1)).tolist():
                    found[done[i]] = self.spelled_out(done[i], found[done[i]])
                who, symbols, scores, pieces, best = who[is_open], symbols[is_open], scores[is_open], pieces[is_open], best[is_open]
                rows = np.arange(len(who))
                if not len(who):
                    return
            symbols[rows, best] = pieces[rows, best]
            keep = np.ones(symbols.shape, dtype=bool)
            keep[rows, best + 1] = False
            symbols = symbols[keep].reshape(len(who), width)
            keep = np.ones(scores.shape, dtype=bool)
            keep[rows, best] = False
            scores, pieces = (x[keep].reshape(len(who), width - 1) for x in (scores, pieces))
            for shift in (-1, 0):
                at = best + shift
                hit = np.flatnonzero((at >= 0) & (at < width - 1))
                place = at[hit]
                scores[hit, place], pieces[hit, place] = self.joined(symbols[hit, place], symbols[hit, place + 1])

    def spelled_out(self, text, symbols):
        """Ids of symbols some of which are no pieces; the characters of `text` that have no number stand in their order."""
        others = (c for c in text if self.letter_symbol[ord(c)] == self.other)
        ids = []
        for s in symbols:
            ids += (s,) if s < self.pieces_end else self.spelled(next(others) if s == self.other else self.symbol_text[s], None)
        return ids

    def agenda(self, text):
        """Ids of normalised text: merge the best pair first, leftmost among equals."""
        symbols = self.merged_short(text) if len(text) <= SHORT else self.merged_long(text)
        ids = list(map(self.ids.get, symbols))
        if None not in ids:
            return ids
        return list(chain.from_iterable(map(self.spelled, symbols, ids)))

    def spelled(self, symbol, own):
        """The ids of one symbol: its own, or its bytes' pieces where it is no piece."""
        if own is not None:
            return (own,)
        return [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else (self.unknown,)

    def merged_short(self, text):
        """The agenda as an array of pair scores, whose first smallest entry is next; quickest for words."""
        score_of, symbols = self.scores.get, list(text)
        agenda = [score_of(pair, NEVER) for pair in map(add, symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] = piece = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = score_of(piece + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score_of(symbols[i - 1] + piece, NEVER)
        return symbols

    def merged_long(self, text):
        """The agenda as a heap of (score, place, piece); entries that a merge has outdated are skipped."""
        score_of, symbols = self.scores.get, list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = list(map(add, symbols, symbols[1:]))
        heap = [(score, i, pairs[i]) for i, score in enumerate(map(score_of, pairs)) if score is not None]
        heapq.heapify(heap)
        while heap:
            _, left, piece = heapq.heappop(heap)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                score = score_of(piece + symbols[end])
                if score is not None:
                    heapq.heappush(heap, (score, left, piece + symbols[end]))
            start = before[left]
            if start >= 0:
                score = score_of(symbols[start] + piece)
                if score is not None:
                    heapq.heappush(heap, (score, start, symbols[start] + piece))
        return [symbol for symbol in symbols if symbol]

    def cut(self, text):
        """Segments of normalised text that merges never join."""
        if not self.separable:
            return [text]
        if SPACE + SPACE not in text:
            first, *rest = text.split(SPACE)
            return [first, *map(SPACE.__add__, rest)] if first else [SPACE + w for w in rest]
        segments = []
        for word in text.split(SPACE):
            # An empty word stands between two marks: the marks of a run go with what follows the run.
            if segments and not segments[-1].strip(SPACE):
                segments[-1] += SPACE + word
            else:
                segments.append((SPACE if segments else "") + word)
        return [s for s in segments if s]

    def learn(self, fresh):
        """Encodes new segments and holds them against the library."""
        if not fresh:
            return
        raw = [s.removeprefix(SPACE).replace(SPACE, " ") for s in fresh]
        found = self.agendas(fresh)
        for segment, text, theirs in zip(fresh, raw, self.library.encode(raw, num_threads=1)):
            own = found[segment]
            if own != theirs and self.library.normalize(text) == segment:
                raise ValueError(f"agenda and library differ on {segment!r}: {own} and {theirs}")
            # Tuples of numbers, unlike lists, are no burden to the garbage collector.
            self.segments[segment] = tuple(own)

    def encode(self, texts):
        """Ids of each text of an Arrow batch."""
        rows = [self.cut(t) if t else [] for t in (self.library.normalize(t) if t else "" for t in texts)]
        out = []
        for i in range(0, len(rows), TEXTS):
            some = rows[i : i + TEXTS]
            if len(self.segments) > SEGMENT_LIMIT:
                # What has not been asked for lately is forgotten.
                self.older, self.segments = self.segments, {}
            fresh = set(chain.from_iterable(some)).difference(self.segments)
            self.segments.update({s: self.older[s] for s in fresh if s in self.older})
            self.learn([s for s in fresh if s not in self.segments])
            get = self.segments.__getitem__
            out += [list(chain.from_iterable(map(get, row))) for row in some]
        return out


@cache
def piece_encoder(path):
    """One encoder per worker process and model file."""
    return PieceEncoder(path)


def default_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(text: Column, path: str) -> Column:
    """The ids of a text column, as array<int>."""

    def make():
        encoder = piece_encoder(path)

        def work(texts):
            rows = encoder.encode([t.decode() if t else "" for t in texts])
            offsets = np.cumsum([0, *map(len, rows)])
            flat = np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

        return work

    return text_function(make, "array<int>", "encode_pieces")(text)


def decode_pieces(ids: Column, path: str) -> Column:
    """The text of an array<int> column of ids, by the library's decoder; null gives the empty text."""
    from typing import Iterator

    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = piece_encoder(path).library
        for batch in batches:
            yield pa.array(library.decode([x or [] for x in batch.to_pylist()]) if len(batch) else [], pa.string())

    decode_ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode_ids, "string")(ids)


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encoding and decoding in one pass, keeping only digests."""

    def make():
        encoder = piece_encoder(path)
        digits = encoder.digits.__getitem__

        def work(texts):
            rows = []
            for i in range(0, len(texts), TEXTS):
                found = encoder.encode([t.decode() if t else "" for t in texts[i : i + TEXTS]])
                for ids, decoded in zip(found, encoder.library.decode(found)):
                    listed = ",".join(map(digits, ids)).encode()
                    rows.append(
                        {
                            "n_tokens": len(ids),
                            "ids_sha256": hashlib.sha256(listed).hexdigest(),
                            "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(),
                        }
                    )
            return pa.array(rows, DIGEST)

        return work

    return text_function(make, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>", "round_trip")(text)
