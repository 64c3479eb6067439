"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The model is a file of pieces with scores. Encoding puts a mark before the text, turns spaces into
marks, and cuts the result before every mark that follows another character: no piece reaches over such
a place, so every part has its own best path. One pass of the automaton over a part visits, at each
position, the pieces ending there along the output links. A piece relaxes its end position if it can
follow the best path at its start. For a model of merges "can follow" means that merging by scores
keeps the two pieces apart, which is decided from the pieces' own merges; exactly one piece at each
reachable position passes, so one pass and a walk back give the ids of the merging encoder. Characters
without a piece become byte pieces. Parts are remembered (bounded) since words repeat.

Decoding joins pieces and bytes, turns marks into spaces and drops the first. Texts that hold the mark
character itself come back with a space there; all others come back unchanged. Null and empty texts
have no ids. Texts count whole. Repeated rows are repeated; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jetframe.llm.texts import pieces

MARK = "\u2581"
REMEMBERED = 600_000
LONGEST_KEY = 32
KIND = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_chars bigint, round_trip boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(piece[3:5], 16)
                self.bytes[value] = number
                self.text.append(bytes([value]))
            elif model.is_control(number) or model.is_unknown(number):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(MARK, " ").encode())
                self.ids[piece] = number
                self.rank[piece] = -model.get_score(number)
        self.last_merge: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            symbols, merge = self._merge(piece)
            if len(symbols) == 1:  # others never result from merging
                self.last_merge[piece] = merge
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.letters = frozenset(p for p in self.last_merge if len(p) == 1)
        self.apart: dict[tuple[str, str], bool] = {("", p): True for p in self.last_merge}
        self.known: dict[str, bytes] = {}
        single = "".join(re.escape(c) for c in "\n\t\r" if c not in self.ids)
        self.parts = re.compile(f"{MARK}*[^{MARK}{single}]+|{MARK}+|[{single}]")

    def _merge(self, piece: str) -> tuple[list[str], tuple[str, str] | None]:
        """Symbols after merging a piece's characters by score, and the last merge."""
        symbols, last = list(piece), None
        while len(symbols) > 1:
            rank, at = min(
                (self.rank.get(a + b, np.inf), n)
                for n, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
            )
            if rank == np.inf:
                break
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = ["".join(last)]
        return symbols, last

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends in exactly these two pieces.

        The merge that built a piece came before anything of a higher rank. Going back in time, the
        later of the two pieces is taken apart; a pair across the border whose merge would have come
        before that moment would have been taken.
        """
        key = (left, right)
        answer = self.apart.get(key)
        if answer is None:
            if len(self.apart) > REMEMBERED * 2:
                self.apart = {k: True for k in self.apart if not k[0]}
            answer = self.apart[key] = self._stay_apart(left, right)
        return answer

    def _stay_apart(self, left: str, right: str) -> bool:
        # Time of a state: merges up to (rank, side) are done; of equal ranks the left one is first.
        until = (np.inf, 1)
        while True:
            across = self.rank.get(left + right, np.inf)
            # On a tie the leftmost pair is merged first: one inside ``left`` precedes the border,
            # the border precedes one inside ``right``.
            if across < np.inf and (across, 0.5) < until:
                return False
            built_left, built_right = self.last_merge.get(left), self.last_merge.get(right)
            time_left = (self.rank[left], 0) if built_left else (-1, 0)
            time_right = (self.rank[right], 1) if built_right else (-1, 0)
            if not built_left and not built_right:
                return True
            if time_left > time_right:
                until, left = time_left, built_left[1]
            else:
                until, right = time_right, built_right[0]

    def _part(self, part: str) -> bytes:
        """Ids of one part as unsigned 32-bit numbers."""
        if self.letters.issuperset(part):
            return array("I", self._path(part)).tobytes()
        out: list[int] = []
        start = 0
        for at, character in enumerate(part):
            if character not in self.letters:  # nothing merges with it: what is before is complete
                out += self._path(part[start:at]) + self._fallback(character)
                start = at + 1
        return array("I", out + self._path(part[start:])).tobytes()

    def _path(self, part: str) -> list[int]:
        """Ids of the best path over characters that are all pieces."""
        size = len(part)
        best: list[str | None] = [None] * (size + 1)
        best[0] = ""
        apart = self.apart
        for end, piece in self.automaton.iter(part):
            end += 1
            if best[end] is None:
                before = best[end - len(piece)]
                if before is not None:
                    passes = apart.get((before, piece))
                    if passes is None:
                        passes = self.stay_apart(before, piece)
                    if passes:
                        best[end] = piece
        out: list[int] = []
        ids, at = self.ids, size
        while at:
            piece = best[at]
            out.append(ids[piece])
            at -= len(piece)
        out.reverse()
        return out

    def _fallback(self, character: str) -> list[int]:
        """Byte pieces of a character."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode()]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for part in self.parts.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(part)
            if ids is None:
                ids = self._part(part)
                if len(part) <= LONGEST_KEY:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = self.text
        found = b"".join([text[n] for n in np.frombuffer(ids, "<u4").tolist()])
        return found.decode(errors="replace")[1:]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of (doc_id, text) rows."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for rows, texts in pieces(batch):
                ids = [
                    np.frombuffer(own.encode(t.decode()), "<u4").astype(np.int32) for t in texts
                ]
                yield pa.record_batch(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [
                own.decode(np.asarray(ids or [], "<u4").tobytes())
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encode_and_back(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_chars, round_trip): every text encoded and decoded."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for rows, texts in pieces(batch):
                out = []
                for raw in texts:
                    text = raw.decode()
                    ids = own.encode(text)
                    back = own.decode(ids)
                    out.append((len(ids) // 4, zlib.crc32(ids), len(back), back == text))
                columns = list(zip(*out, strict=True))
                yield pa.record_batch(
                    [
                        rows.column("doc_id").cast(pa.int64()),
                        *(pa.array(c, pa.int64()) for c in columns[:3]),
                        pa.array(columns[3], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_chars", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, KIND)
