"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts fall apart into units (spaces and the text after them) that no piece crosses. The new units of a batch lie one after
the other in flat numpy arrays of symbols. A round looks up the rank of every adjacent pair, finds the smallest rank of each
unit, merges the leftmost pair of that rank in all units at once and compacts the arrays; rounds go on until no pair is
left. Equal pairs of a unit are merged in the same round where no later merge could come in between. The rounds of a unit are as
many as its different merges, so units of more than LONG_UNIT characters (texts without spaces) take the same merges from a heap
instead, in a time that grows with n log n.

Defined cases: a NULL or empty text has no ids and decodes to an empty text; characters that are no piece become byte
pieces; repeated rows are encoded like any others; other columns of the input have no effect.
"""

from __future__ import annotations

import heapq
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from vitrina.llm.common import map_rows

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
CACHED_UNITS = 500_000
CACHED_LENGTH = 64
HASH_BITS = 20
NO_RANK = np.int64(1 << 40)
LONG_UNIT = 2048
PLACE_BITS = 32


class PieceCodec:
    """Tables of one vocabulary, and the merge rounds over them. `model` is the content of a model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = loaded.get_piece_size()
        self.bytes_at = [loaded.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
        self.byte_of = {str(number): value for value, number in enumerate(self.bytes_at)}
        special = {n for n in range(size) if loaded.is_control(n) or loaded.is_unknown(n) or loaded.is_byte(n) or loaded.is_unused(n)}
        pieces = {loaded.id_to_piece(n): n for n in range(size) if n not in special}
        self.text_of_id = {str(n): piece for piece, n in pieces.items()}
        inner = [piece for piece in pieces if SPACE in piece.lstrip(SPACE)]
        if inner:
            raise ValueError("pieces with spaces inside need other units")
        self.size = size
        # Characters that occur in pieces without being pieces get numbers above the vocabulary.
        symbols = dict(pieces)
        for piece in pieces:
            for character in piece:
                symbols.setdefault(character, size + len(symbols))
        self.other = max(symbols.values(), default=size) + 1  # all characters of no piece; these never merge
        self.base = np.int64(self.other + 1)
        scores = sorted({-loaded.get_score(n) for n in pieces.values()})
        rank_of = {score: rank for rank, score in enumerate(scores)}
        rank = {piece: rank_of[-loaded.get_score(n)] for piece, n in pieces.items()}
        keys, ranks, made, unsafe = [], [], [], set()
        for piece, number in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * int(self.base) + right)
                ranks.append(rank[piece])
                made.append(number)
                # A piece that ranks no later than its own part could be merged before the next equal pair.
                unsafe.update(part for part in (piece[:cut], piece[cut:]) if len(part) > 1 and rank[piece] <= rank[part])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        self.tables = self._hash_tables(self.keys)
        self.unsafe = np.zeros(int(self.base) + 1, bool)
        self.unsafe[[pieces[piece] for piece in unsafe]] = True
        # The symbol of every code point; the ids of every symbol as text.
        self.symbol_at = np.full(0x110000, self.other, np.int64)
        for character, number in symbols.items():
            if len(character) == 1:
                self.symbol_at[ord(character)] = number
        self.ids_of, self.pieces_of = [""] * self.other, [""] * self.other
        for piece, number in symbols.items():
            self.ids_of[number] = str(number) if number < size else self._bytes(piece)
            self.pieces_of[number] = piece
        self.pairs: dict[int, tuple[int, int]] | None = None  # rank and result by pair, made when a long unit needs it
        self.cache: dict[str, str] = {}  # ids of a unit, joined by commas
        self.changed: dict[str, str] = {}  # decoded text of the units that decode to another text

    @staticmethod
    def _hash_tables(keys: np.ndarray) -> list[tuple[np.uint64, np.ndarray]]:
        """Multipliers and tables: a key's slot of the first table that kept the key holds its index."""
        tables, left, multiplier = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            table = np.full(1 << HASH_BITS, -1, np.int32)
            slot = (keys[left].astype(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - HASH_BITS)
            table[slot] = left
            tables.append((np.uint64(multiplier), table))
            left = left[table[slot] != left]
            multiplier = multiplier * 0xD1342543DE82EF95 % (1 << 64) | 1
        return tables

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key among the pairs, -1 for others."""
        found, hashed = np.full(len(key), -1, np.int64), key.astype(np.uint64)
        open_at = None
        for multiplier, table in self.tables:
            part = hashed if open_at is None else hashed[open_at]
            at = table[(part * multiplier) >> np.uint64(64 - HASH_BITS)].astype(np.int64)
            right = (at >= 0) & (self.keys[at] == (key if open_at is None else key[open_at]))
            if open_at is None:
                found[right] = at[right]
                open_at = np.flatnonzero(~right & (at >= 0))
            else:
                found[open_at[right]] = at[right]
                open_at = open_at[~right & (at >= 0)]
        return found

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The merges of one long unit, one after the other from a heap of (rank, place): a round of all would cost its length each."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        pairs, base = self.pairs, int(self.base)
        at = self._find(ids[:-1] * self.base + ids[1:])
        found = np.flatnonzero(at >= 0)
        heap = ((self.ranks[at[found]] << PLACE_BITS) | found).tolist()
        heapq.heapify(heap)
        symbols = ids.tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        end = len(symbols)
        while heap:
            rank, place = divmod(heapq.heappop(heap), 1 << PLACE_BITS)
            if symbols[place] < 0 or (right := after[place]) == end:
                continue
            pair = pairs.get(symbols[place] * base + symbols[right])
            if pair is None or pair[0] != rank:
                continue  # one of the two has been merged since
            symbols[place], symbols[right] = pair[1], -1
            after[place] = following = after[right]
            if following < end:
                before[following] = place
                pair = pairs.get(symbols[place] * base + symbols[following])
                if pair is not None:
                    heapq.heappush(heap, pair[0] << PLACE_BITS | place)
            if (left := before[place]) >= 0:
                pair = pairs.get(symbols[left] * base + symbols[place])
                if pair is not None:
                    heapq.heappush(heap, pair[0] << PLACE_BITS | left)
        left = np.array(symbols, np.int64)
        return left[left >= 0]

    def _merge(self, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_ids, done_unit = [], []
        numbers, starts, lengths = np.unique(unit, return_index=True, return_counts=True)
        for k in np.flatnonzero(lengths > LONG_UNIT).tolist():
            merged = self._merge_long(ids[starts[k] : starts[k] + lengths[k]])
            done_ids.append(merged)
            done_unit.append(np.full(len(merged), numbers[k]))
        if done_ids:
            short = np.repeat(lengths <= LONG_UNIT, lengths)
            ids, unit = ids[short], unit[short]
        while len(ids) > 1:
            key = ids[:-1] * self.base + ids[1:]
            at = self._find(key)
            fits = (at >= 0) & (unit[:-1] == unit[1:])
            rank = np.where(fits, self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            open_unit = np.repeat(least < NO_RANK, lengths)
            if not open_unit.all():  # units without pairs are ready; later rounds need not look at them
                done_ids.append(ids[~open_unit])
                done_unit.append(unit[~open_unit])
                keep = np.flatnonzero(open_unit)
                if not len(keep):
                    ids = ids[:0]
                    unit = unit[:0]
                    break
                ids, unit, rank, at = ids[keep], unit[keep], np.r_[rank, NO_RANK][keep], np.r_[at, 0][keep]
                starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
                lengths = np.diff(np.r_[starts, len(ids)])
                least = least[least < NO_RANK]
            else:
                rank, at = np.r_[rank, NO_RANK], np.r_[at, 0]
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            first = np.r_[True, unit[hit][1:] != unit[hit][:-1]]
            made = self.made[at[hit]]
            # Pairs of the same piece as the leftmost one may go with it, unless that could change the order of merges.
            leading = np.repeat(made[first], np.diff(np.r_[np.flatnonzero(first), len(hit)]))
            chosen = first | ((made == leading) & ~self.unsafe[leading])
            hit, made, leading = hit[chosen], made[chosen], leading[chosen]
            # Of overlapping pairs, every second one counted from the left of a run.
            run_starts = np.r_[True, (np.diff(hit) != 1) | (unit[hit][1:] != unit[hit][:-1])]
            run_at = np.flatnonzero(run_starts)
            offset = np.arange(len(hit)) - np.repeat(run_at, np.diff(np.r_[run_at, len(hit)]))
            hit, made = hit[offset % 2 == 0], made[offset % 2 == 0]
            ids = ids.copy()
            ids[hit] = made
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, unit = ids[keep], unit[keep]
        ids = np.concatenate([*done_ids, ids])
        unit = np.concatenate([*done_unit, unit])
        order = np.argsort(unit, kind="stable")
        return ids[order], unit[order]

    def _bytes(self, character: str) -> str:
        return ",".join(str(self.bytes_at[value]) for value in character.encode())

    def encode_units(self, units: list[str]) -> tuple[list[str], list[int]]:
        """Ids of each unit, joined by commas, and the units that do not decode to themselves piece by piece."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        ids = self.symbol_at[codes]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        if not len(ids):
            return [""] * len(units), []
        unknown = codes[ids == self.other]
        merged, owner = self._merge(ids, unit)
        ends = np.searchsorted(owner, np.arange(len(units)), side="right")
        starts = np.r_[0, ends[:-1]]
        ids_of, other = self.ids_of, self.other
        numbers = merged.tolist()
        if len(unknown):
            left = iter(unknown.tolist())
            texts = [ids_of[n] if n != other else self._bytes(chr(next(left))) for n in numbers]
        else:
            texts = [ids_of[n] for n in numbers]
        spans = list(zip(starts.tolist(), ends.tolist()))
        doubtful = np.unique(owner[merged >= self.size]).tolist()
        # Decoding is checked for all units without byte pieces at once: the pieces of these ids must spell the units.
        plain = merged < self.size
        plain[np.isin(owner, doubtful)] = False
        pieces = self.pieces_of
        skipped = set(doubtful)
        spelled = "".join([pieces[n] for n in merged[plain].tolist()])
        if spelled != "".join([u for k, u in enumerate(units) if k not in skipped]):
            doubtful = list(range(len(units)))
        return [",".join(texts[start:end]) for start, end in spans], doubtful

    def decode_ids(self, ids: list[str]) -> str:
        """Text of ids (as decimal texts), with the mark of the first space still in front."""
        texts = [self.text_of_id.get(n) for n in ids]
        if None not in texts:
            return "".join(texts)
        out, held = [], bytearray()
        for number, piece in zip(ids, texts):
            if piece is None and number in self.byte_of:
                held.append(self.byte_of[number])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(piece or "")
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def units(self, text: str) -> list[str]:
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _learn(self, units: set[str]) -> dict[str, str]:
        """Encode and decode the units that are new. Short ones go to the cache, the ids of long ones are returned."""
        if len(self.cache) > CACHED_UNITS:
            self.cache.clear()
            self.changed.clear()
        cache = self.cache
        new = [u for u in units if u not in cache]
        long = {}
        encoded, doubtful = self.encode_units(new)
        cache.update(zip(new, encoded))
        for unit, ids in zip(new, encoded):
            if len(unit) > CACHED_LENGTH:
                long[unit] = cache.pop(unit)
        for k in doubtful:
            decoded = self.decode_ids(encoded[k].split(","))
            if decoded != new[k]:
                self.changed[new[k]] = decoded
        return long

    def run(self, texts: list[str | None]) -> tuple[list[str], list[int], list[str]]:
        """Of each text: ids joined by commas, their number, the text decoded from them."""
        split = [self.units(text) if text else [] for text in texts]
        long, cache = self._learn(set().union(*split)), self.cache
        ids_of = (lambda u: long.get(u) or cache[u]) if long else cache.__getitem__
        ids = [",".join(map(ids_of, units)) for units in split]
        counts = [row.count(",") + 1 if row else 0 for row in ids]
        changed = self.changed
        decoded = [
            "".join([changed.get(u, u) for u in units] if changed else units).replace(SPACE, " ")[1:] for units in split
        ]
        for unit in long:
            changed.pop(unit, None)
        return ids, counts, decoded


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text", keep=("doc_id",), digests: bool = True) -> DataFrame:
    """Ids and decoded text of every row, as SHA-256 digests or (`digests=False`) as they are.

    The model file travels as a broadcast of its own fixed size (about half a megabyte here); executors read no local file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: dict[str, PieceCodec] = {}

    def convert(part):
        if "codec" not in made:
            made["codec"] = PieceCodec(shared.value)
        ids, counts, decoded = made["codec"].run(part.column(text).to_pylist())
        if digests:
            sha = lambda value: hashlib.sha256(value.encode()).hexdigest()
            return {"n_tokens": counts, "ids_sha256": map(sha, ids), "decoded_sha256": map(sha, decoded)}
        return {"n_tokens": counts, "ids": [[int(n) for n in row.split(",")] if row else [] for row in ids], "decoded": decoded}

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    inputs = list(dict.fromkeys([*keep, text]))
    return map_rows(docs.select(*inputs), convert, columns, keep)
