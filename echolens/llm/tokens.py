"""Exact token ids of whole texts, for use inside tasks.

Texts of plain Latin characters go through a faster library with the same vocabulary, for two kinds of tokenizer:
byte-level BPE without a normalizer, and lower-casing BPE with word ends. Other texts take the tokenizer itself, with a
cache of pieces for the first kind: there a space before a character other than white space always begins a token, and
what follows it does not depend on what came before, so a text may be cut there. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np

from echolens.llm.common import per_process

# Pieces kept per worker process, and pieces of one text looked up at a time; both bound memory only.
_CACHE_PIECES = 300_000
_SLICE = 200_000
#: Marks that stand behind a word; after Latin letters they never belong to its tokens.
_MARKS, _LATIN = ".,;:!?", "\u024f"
# Characters given to the library at once.
_JOINED_CHARS = 50_000


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return sha256(file.read()).hexdigest()


def _cuttable(spec: dict) -> bool:
    """Whether the rule above holds: byte-level pieces, no normalizer, added tokens without spaces or stripping."""
    splitter = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space")
        and not any(
            t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or " " in t["content"]
            for t in spec.get("added_tokens", [])
        )
    )


# The patterns of byte-level pieces and of the lower-casing kind.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_WORD_END = "</w>"
# The first one where no two blanks meet: it needs no look ahead.
_SINGLE_BLANKS = _PATTERN.replace(r"|\s+(?!\S)", "")
# What stands between the letters of lower-cased plain text: contractions, single digits, runs of marks.
_DIGITS, _LETTERS = "0-9²³¹¼-¾", "a-zªµºß-öø-ſ"
_MARKS_BETWEEN = re.compile(rf"[{_DIGITS}]|[^\s{_DIGITS}{_LETTERS}]+")
_BETWEEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_MARKS_BETWEEN.pattern}")
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")


def _byte_values() -> dict[str, int]:
    """The bytes that the letters of byte-level vocabularies stand for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}


def _merges_in_order(spec: dict, least: int) -> bool:
    """Whether merges come in the order of their ids, so that ids can serve as ranks."""
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"].get("".join(pair), -1) for pair in pairs]
    return made == sorted(set(made)) and made[:1] >= [least]


def _ranks(spec: dict, pattern: str = _PATTERN):
    """A byte-level vocabulary for the faster library; None if its merges do not come in the order of their ids."""
    import tiktoken

    if not _merges_in_order(spec, 256):
        return None
    letters, added = _byte_values(), {token["content"] for token in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _word_ranks(spec: dict):
    """A vocabulary with word ends for the faster library, a space marking the end; None if it is of another kind.

    Ends are joined to their last byte before any merge, which the order of ids says as well.
    """
    import tiktoken

    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    words = {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}
    bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    if (
        normalizers != [{"type": "NFC"}, blanks, {"type": "Lowercase"}]
        or splitters != [words, bytes_]
        or spec["model"].get("end_of_word_suffix") != _WORD_END
        or not _merges_in_order(spec, 512)
    ):
        return None
    letters, added, ranks = _byte_values(), {token["content"] for token in spec.get("added_tokens", [])}, {}
    for token, i in spec["model"]["vocab"].items():
        if token not in added:
            base = token.removesuffix(_WORD_END)
            ranks[bytes(letters[c] for c in base) + b" " * (base != token)] = i
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def _latin(text: str) -> bool:
    """Printable Latin characters and line feeds, of which both libraries have the same view."""
    return (text.isascii() or not _BEYOND_LATIN.search(text)) and text.replace("\n", "").isprintable()


def _quick(spec: dict) -> Callable[[str], list[int] | None] | None:
    """Ids of a plain text by the faster library, None for a text that is not plain; no function for other kinds."""
    marks = [token["content"] for token in spec.get("added_tokens", [])]

    def plain(text: str) -> bool:
        return _latin(text) and not any(mark in text for mark in marks)

    if _cuttable(spec) and (ranks := _ranks(spec, _SINGLE_BLANKS)):
        pairs = ("  ", " \n", "\n ", "\n\n")
        return lambda text: (
            ranks.encode_ordinary(text) if plain(text) and not any(pair in text for pair in pairs) else None
        )
    if words := _word_ranks(spec):

        def lowered(text: str) -> list[int] | None:
            if not plain(text):
                return None
            between = _BETWEEN if "'" in text else _MARKS_BETWEEN
            return words.encode_ordinary(between.sub(r" \g<0> ", text.lower()).replace("\n", " ") + " ")

        return lowered
    return None


def _plain(piece: str) -> bool:
    return (piece.isascii() or max(piece) <= _LATIN) and (piece.isprintable() or piece.replace("\n", "").isprintable())


class PieceEncoder:
    """Encodes texts to the little-endian bytes of their ids, two bytes each if the vocabulary allows, else four.

    Plain Latin texts, and new pieces of other texts that are plain, go through a faster library with the same
    vocabulary, all others through the tokenizer itself; tests hold both against the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cuttable = _cuttable(spec)
        # Byte-level vocabularies write a leading space as this letter.
        self.leads = np.zeros(size, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.added = [token["content"] for token in spec.get("added_tokens", [])]
        self.ranks = _ranks(spec) if self.cuttable else None
        self.quick = _quick(spec)
        self.cache: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _whole(self, text: str) -> bytes:
        found = self.odd.get(text)
        if found is None:
            found = self._ids(text).tobytes()
            if len(text) <= 64:
                if len(self.odd) >= _CACHE_PIECES // 4:
                    self.odd.clear()
                self.odd[text] = found
        return found

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces, each after a space. Closing marks after Latin letters are tokens of their own."""
        ends = {p: p.rstrip(_MARKS) for p in pieces}
        split = {p: base for p, base in ends.items() if base != p and base.isalpha() and max(base) <= _LATIN}
        fresh = [p for p in pieces if p not in split] + list(set(split.values()).difference(self.cache, pieces))
        plain = [p for p in fresh if self.ranks and _plain(p)]
        for part, quick in ((plain, True), (list(set(fresh).difference(plain)), False)):
            start = 0
            while start < len(part):
                end, chars = start, 0
                while end < len(part) and (end == start or chars < _JOINED_CHARS):
                    chars += len(part[end]) + 1
                    end += 1
                self._learn_together(part[start:end], quick)
                start = end
        self.cache.update((p, self.cache[base] + self._whole(p[len(base) :])) for p, base in split.items())

    def _learn_together(self, pieces: list[str], quick: bool) -> None:
        """Encode pieces as one text; ids that begin with a space mark where each one starts."""
        joined = " " + " ".join(pieces)
        if quick and not any(token in joined for token in self.added):
            ids = np.array(self.ranks.encode_ordinary(joined), self.dtype)
        else:
            ids = self._ids(joined)
        firsts = np.flatnonzero(self.leads[ids])
        if len(firsts) == len(pieces):
            raw, width = ids.tobytes(), self.dtype.itemsize
            bounds = [*(firsts * width).tolist(), len(raw)]
            self.cache.update((p, raw[a:b]) for p, a, b in zip(pieces, bounds, bounds[1:]))
        else:
            self.cache.update((p, self._ids(" " + p).tobytes()) for p in pieces)

    def _slice(self, pieces: list[str]) -> bytes:
        """Ids of pieces that each follow a space and begin with something else than white space."""
        self._trim()
        self._learn(list(set(pieces).difference(self.cache)))
        return b"".join(map(self.cache.__getitem__, pieces))

    def _trim(self) -> None:
        """Make room; the pieces learned first are the common ones, as a rule, and stay."""
        if len(self.cache) > _CACHE_PIECES:
            self.cache = dict(islice(self.cache.items(), _CACHE_PIECES // 2))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts, whose new pieces are learned together; give at most a few megabytes at once."""
        if not self.quick:
            return self._encode_pieces(texts)
        found = [self.quick(text) for text in texts]
        others = iter(self._encode_pieces([text for text, ids in zip(texts, found) if ids is None]))
        return [next(others) if ids is None else np.array(ids, self.dtype).tobytes() for ids in found]

    def _around_odd_words(self, text: str) -> bytes:
        """Where tokens never reach over a space: runs of plain words together, each other word by itself."""
        out, run = [], []
        for piece in text.split(" "):
            ids = None if _latin(piece) else self._whole(piece)
            if ids is None:
                run.append(piece)
                continue
            out.append(self._run(" ".join(run)))
            out.append(ids)
            run = []
        return b"".join([*out, self._run(" ".join(run))])

    def _run(self, text: str) -> bytes:
        ids = self.quick(text)
        return self._whole(text) if ids is None else np.array(ids, self.dtype).tobytes()

    def _encode_pieces(self, texts: list[str]) -> list[bytes]:
        if self.quick and not self.cuttable:
            return [self._around_odd_words(text) for text in texts]
        if not self.cuttable:
            return [self._ids(text).tobytes() for text in texts]
        cut = [text.split(" ") for text in texts]
        if sum(map(len, cut)) > _SLICE and len(texts) > 1:
            half = len(texts) // 2
            return self._encode_pieces(texts[:half]) + self._encode_pieces(texts[half:])
        if len(texts) == 1 and len(cut[0]) > _SLICE:
            return [self._around_blanks(cut[0])]
        self._trim()
        found = [list(map(self.cache.get, pieces)) for pieces in cut]
        gaps = [[i for i, ids in enumerate(known) if ids is None] if None in known else [] for known in found]
        missing = {pieces[i] for pieces, places in zip(cut, gaps) for i in places if i}
        loose = {p for p in missing if not p or _blank(p[0])}
        self._learn(list(missing - loose))
        out = []
        for pieces, known, places in zip(cut, found, gaps):
            if loose and any(pieces[i] in loose for i in places if i):
                out.append(self._around_blanks(pieces))
                continue
            for i in places:
                known[i] = self.cache[pieces[i]] if i else b""
            known[0] = self._whole(pieces[0])
            out.append(b"".join(known))
        return out

    def _around_blanks(self, pieces: list[str]) -> bytes:
        """The same where white space comes in runs: a run stays together with what stands before it."""
        out, run, plain = [], [pieces[0]], []
        for piece in pieces[1:]:
            if not piece or _blank(piece[0]):
                if plain:
                    out.append(self._slice(plain[:-1]))
                    run, plain = ["", plain[-1]], []
                run.append(piece)
            elif run:
                out.append(self._whole(" ".join(run)))
                run, plain = [], [piece]
            else:
                plain.append(piece)
                if len(plain) > _SLICE:
                    out.append(self._slice(plain[:-1]))
                    plain = plain[-1:]
        out.append(self._slice(plain))
        if run:
            out.append(self._whole(" ".join(run)))
        return b"".join(out)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // self.dtype.itemsize

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        return [np.frombuffer(raw, self.dtype) for raw in self.encode_all([text or "" for text in texts])]


def _blank(char: str) -> bool:
    """White space by any library's measure; taking more characters for it is always safe."""
    return char.isspace() or char == "᠎"


def encoder(path: str) -> PieceEncoder:
    """This worker process's encoder for the tokenizer file at ``path``."""
    encoders = per_process("encoders", dict)
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    return encoders[path]


def chunks(table, column: str, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch whose texts are about ``most_chars`` bytes together, so that output stays small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_chars:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
