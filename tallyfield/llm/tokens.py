"""Encoding texts with a tokenizer, each distinct piece of text once.

Two places are cuts for certain: a blank between two characters that are no white space, and, for the
byte-level tokenizer, a line feed (or two) between such characters. The ids of a text are those of its
pieces between such cuts, one after another. Pieces recur far more often than whole texts. New ones are
encoded many at a time, joined by line feeds, which costs a third of encoding them singly. Tokenizers
that do not cut this way, and texts that hold the text of a special token, are encoded whole. The texts
of an Arrow column are cut together, and each distinct piece of theirs is looked up once.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters that are surely no white space: letters, digits, the visible ASCII signs.
_SEEN = r"[\w!-~]"
CUT = re.compile(rf"(?<={_SEEN}) (?={_SEEN})")
_ODD_BLANK = rf" (?:(?<!{_SEEN} )|(?!{_SEEN}))"
_ODD_FEED = r"\n(?:(?<![\w!-~\n]\n)|(?![\w!-~\n])|(?=\n\n))"
ODD_BLANKS = re.compile(_ODD_BLANK)
_ODD = re.compile(rf"{_ODD_BLANK}|{_ODD_FEED}")
# The same for Arrow, whose patterns do not look around.
_SURE = r"\p{L}\p{N}_!-~"
_ODD_IN_ARROW = rf"\A[ \n]|[ \n]\z|[^{_SURE}] | [^{_SURE}]|[^{_SURE}\n]\n|\n[^{_SURE}\n]|\n\n\n"
_JOINED = 20_000
# Runs of signs behind letters: so long at most, and so many, are remembered by themselves.
_LONGEST_RUN = 8
_MOST_RUNS = 20_000
# Pieces held in a worker: at most so many, of so many characters and bytes of ids together.
MOST_PIECES = 700_000
MOST_BYTES = 32_000_000


def byte_signs() -> str:
    """The byte-level spelling: the sign for each byte. A visible byte is the sign of that number, the
    others are numbered on from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in seen)
    return "".join(chr(b) if b in seen else chr(256 + n) for b, n in sorted([*((b, 0) for b in seen), *((b, i) for i, b in enumerate(hidden))]))


_SIGNS = dict(enumerate(byte_signs()))


def _spelt(text: str) -> str:
    return text.encode().decode("latin-1").translate(_SIGNS)


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


class PieceIds:
    """The ids of pieces, as bytes, remembered up to a bound."""

    def __init__(
        self,
        encode: Callable[[set[str]], dict[str, bytes]],
        most_pieces: int = MOST_PIECES,
        most_bytes: int = MOST_BYTES,
    ):
        """``encode`` gives the ids of pieces, and of others too if it likes."""
        self.encode, self.most_pieces, self.most_bytes = encode, most_pieces, most_bytes
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def of(self, groups: list[list[str]]) -> list[bytes]:
        """For each group of pieces its ids, one piece after another."""
        self._turn()
        self._meet(set().union(*groups).difference(self.known))
        of = self.known.__getitem__
        return [b"".join(map(of, group)) for group in groups]

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        self._turn()
        found = list(map(self.known.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        self._meet({pieces[i] for i in missing})
        for i in missing:
            found[i] = self.known[pieces[i]]
        return found

    def _turn(self) -> None:
        """Two generations: what is met again moves to the newer, the older is let go."""
        if len(self.known) > self.most_pieces // 2 or self.held > self.most_bytes // 2:
            self.before, self.known, self.held = self.known, {}, 0

    def _meet(self, new: set[str]) -> None:
        if self.before and new:
            met = {p: self.before[p] for p in new if p in self.before}
            self._keep(met)
            new.difference_update(met)
        if new:
            self._keep(self.encode(new))

    def _keep(self, pieces: dict[str, bytes]) -> None:
        self.known.update(pieces)
        self.held += sum(map(len, pieces)) + sum(map(len, pieces.values()))


def _cuts_as_known(file: dict) -> bool:
    """Whether a tokenizer file cuts texts by the byte-level rule, and changes nothing else."""
    before = file.get("pre_tokenizer") or {}
    return (
        before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not any(file.get(part) for part in ("normalizer", "truncation", "padding"))
        and (file.get("model") or {}).get("type") == "BPE"
    )


class Encoder:
    """Ids by a file of the ``tokenizers`` library, as ``encode(text, add_special_tokens=False)`` gives
    them. With ``special_as_text`` the strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False, **bounds: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size(True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        added = file.get("added_tokens") or []
        self.special = [] if special_as_text else [t["content"] for t in added if t["special"]]
        self.by_pieces = _cuts_as_known(file) and not any(not t["special"] for t in added)
        if self.by_pieces:
            feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.by_pieces = len(feed) == 1
            self.feed = feed[0]
            self.runs: dict[str, bytes] = {}
            # The same model behind a cutting at blanks alone.
            self.by_words = Tokenizer.from_file(path)
            self.by_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.blank_sign, self.feed_sign = _spelt(" "), _spelt("\n")
            self.pieces = PieceIds(self._encode_pieces, **bounds)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _of_words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words that the cutting rule leaves whole, each behind ``before``: in the tokenizer's own
        spelling they go to the model past the cutting, one line of words for all, a line feed behind each.
        """
        found = []
        for start in range(0, len(words), _JOINED):
            some = [w if w.isascii() else _spelt(w) for w in words[start : start + _JOINED]]
            line = f"{before}{f' {self.feed_sign} {before}'.join(some)} {self.feed_sign}"
            ids = np.array(self.by_words.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) != len(some) or ends[-1] != len(ids) - 1:
                raise AssertionError("a line feed is not a token of its own")
            data, width, at = ids.tobytes(), self.dtype.itemsize, 0
            for end in (ends * width).tolist():
                found.append(data[at:end])
                at = end + width
        return found

    def _encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        # Words of letters alone, behind a blank or at the beginning of a line, are never cut; signs behind
        # them, at the end of a piece, are cut from them.
        known, ids = self.pieces.known, {}
        words, lines, others, signed = set(), set(), [], []
        for piece in pieces:
            stem = piece.rstrip(string.punctuation)
            run = piece[len(stem) :]
            if stem.isalpha():
                group = words
            elif stem[:1] == "\n" and stem[1:].isalpha():
                group = lines
            else:
                others.append(piece)
                continue
            if len(run) > _LONGEST_RUN:
                others.append(piece)
                continue
            if run:
                signed.append((piece, stem, run))
                if stem in known:
                    ids[stem] = known[stem]
                    continue
            group.add(stem)
        ids.update(zip(words, self._of_words(list(words), self.blank_sign), strict=True))
        feed = np.array([self.feed], self.dtype).tobytes()
        found = self._of_words([line[1:] for line in lines], "")
        ids.update((line, feed + x) for line, x in zip(lines, found, strict=True))
        ids.update(zip(others, self._whole([p if p.startswith("\n") else " " + p for p in others]), strict=True))
        if len(self.runs) > _MOST_RUNS:
            self.runs = {}
        runs = list({run for _, _, run in signed}.difference(self.runs))
        self.runs.update(zip(runs, self._whole(runs), strict=True))
        ids.update([(piece, ids[stem] + self.runs[run]) for piece, stem, run in signed])
        return ids

    def encode(self, texts: list[str | None], blank_before: bool = False) -> list[np.ndarray]:
        """The ids of each text (NULL: empty), with a blank put before it if so wished."""
        texts = [t or "" for t in texts]
        if not self.by_pieces:
            found = self._whole([" " + t for t in texts] if blank_before else texts)
            return [np.frombuffer(f, self.dtype) for f in found]
        ids: list[bytes | None] = [None] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            if self.special and any(s in text for s in self.special):
                whole.append(i)
            elif not _ODD.search(text):
                cut.append((i, text.replace("\n", " \n").split(" ")))
            else:
                cut.append((i, CUT.split(text)))
        # A text's first piece stands behind no blank, unless one is put there or it begins a line.
        first = [p[0] for _, p in cut]
        if blank_before:
            heads = [b""] * len(cut)
            whole += [i for (i, _), p in zip(cut, first, strict=True) if p.startswith("\n")]
        else:
            heads = self._whole(first)
        rest = self.pieces.of([p if blank_before else p[1:] for _, p in cut]) if cut else []
        for (i, _), head, tail in zip(cut, heads, rest, strict=True):
            ids[i] = head + tail
        if whole:
            found = self._whole([" " + texts[i] if blank_before else texts[i] for i in whole])
            for i, x in zip(whole, found, strict=True):
                ids[i] = x
        return [np.frombuffer(x, self.dtype) for x in ids]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """As ``encode``: faster on many texts, for more memory (some ten times the texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")  # pieces of one call may exceed a plain array
        whole = np.full(len(texts), not self.by_pieces)
        for special in self.special:
            whole |= _flags(pc.match_substring(texts, special))
        ids: list[np.ndarray | None] = [None] * len(texts)
        if not whole.all():
            found = self._column_by_pieces(texts.filter(pa.array(~whole)))
            for i, x in zip(np.flatnonzero(~whole).tolist(), found, strict=True):
                ids[i] = x
        if whole.any():
            found = self._whole(texts.filter(pa.array(whole)).to_pylist())
            for i, x in zip(np.flatnonzero(whole).tolist(), found, strict=True):
                ids[i] = np.frombuffer(x, self.dtype)
        return ids

    def _column_by_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        odd = _flags(pc.match_substring_regex(texts, _ODD_IN_ARROW))
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        odd_cut = [CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        pieces = pa.concat_arrays([cut.flatten(), pa.array(chain.from_iterable(odd_cut), pa.large_string())])
        # Where the pieces of each text stand: those of ``cut`` come first, then those of ``odd_cut``.
        counts = np.empty(len(texts), np.int64)
        counts[~odd], counts[odd] = pc.list_value_length(cut).to_numpy(), [len(c) for c in odd_cut]
        order = np.argsort(odd, kind="stable")
        ends = np.empty(len(texts), np.int64)
        ends[order] = np.cumsum(counts[order])
        begins = ends - counts
        # A text's first piece stands behind no blank.
        behind = np.ones(len(pieces), bool)
        behind[begins] = False
        coded = pieces.filter(pa.array(behind)).dictionary_encode()
        known = self.pieces.each(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        place = np.empty(len(pieces), np.int64)
        place[behind] = coded.indices.to_numpy()
        place[begins] = np.arange(len(known), len(known) + len(begins))
        known += self._whole(pieces.take(pa.array(begins)).to_pylist())
        # The ids of all texts, one after another, and where those of each piece begin.
        joined = pa.array(known, pa.large_binary()).take(pa.array(place))
        _, at, data = joined.buffers()
        at = np.frombuffer(at, np.int64) // self.dtype.itemsize
        data = np.frombuffer(data or b"", self.dtype)
        return [data[a:b] for a, b in zip(at[begins].tolist(), at[ends].tolist(), strict=True)]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, special_as_text: bool = False, **bounds: int) -> Encoder:
    """The worker's own encoder for a file: it outlives a task, as workers do."""
    key = (path, special_as_text, *sorted(bounds.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text, **bounds)
    return _encoders[key]
