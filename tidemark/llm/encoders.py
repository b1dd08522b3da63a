"""Exact, remembered encoding of texts with public tokenizer files.

Both encoders cut a text only where the tokenizer itself can never join, which they check when the file is loaded,
and give every distinct piece to the library once per worker. Where the check fails, whole texts go to the library.
Memory for remembered pieces is bounded; beyond the bound the oldest state is dropped and learnt anew.
"""

from __future__ import annotations

import array
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 600_000
_loaded: dict[tuple, object] = {}


def once(kind, digest: str, data: bytes):
    """One encoder of a kind for each tokenizer file in a Python worker, kept over its tasks."""
    key = (kind.__name__, digest)
    if key not in _loaded:
        _loaded[key] = kind(data)
    return _loaded[key]


class PieceCounter:
    """Token counts as sentencepiece gives them, without begin or end tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        probe = ["a  b", " a", "a ", "é́ ﬁ", "a b"]
        rebuilt = all("".join(self.lib.encode(x, out_type=str)).replace("▁", " ") == " " + x for x in probe if x.isascii())
        # No piece joins a character to a space that follows it, and spaces are kept: words can be encoded one by one.
        self.by_word = rebuilt and not any(re.search("[^▁]▁", p) for p in pieces)
        self.seen = Remembered(lambda word: len(self.lib.encode(word)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if not self.by_word or "▁" in text or "" in words:
            return len(self.lib.encode(text))
        return sum(map(self.seen.__getitem__, words))


class Remembered(dict):
    """What a function gives for each key, remembered for a bounded number of keys."""

    def __init__(self, of, most: int = REMEMBERED):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.of(key)
        return value


#: Words that are given to the library as one text, and text bytes that are cut into words at a time.
TOGETHER, CUT_BYTES = 500, 8 << 20

#: The shape of tokenizer file for which white space always separates tokens.
SPACE_RULES = ("\\s+", "[^\\s\\p{L}\\p{N}]+")


class WordEncoder:
    """Token ids as the tokenizers library gives them with add_special_tokens=False, as bytes of native unsigned integers."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(model.decode())
        self.lib.no_padding()
        self.lib.no_truncation()
        shape = json.loads(model)
        steps = (shape.get("normalizer") or {}).get("normalizers", [])
        cuts = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = [a.get("content", "") for a in shape.get("added_tokens", []) if not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or re.search(r"\s", a["content"]))]
        self.by_word = (
            [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1].get("pattern", {}).get("Regex") == SPACE_RULES[0]
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0].get("behavior") == "Removed"
            and cuts[0].get("invert")
            and cuts[0].get("pattern", {}).get("Regex", "").endswith(SPACE_RULES[1])
            and not cuts[1].get("add_prefix_space")
            and shape.get("post_processor") is None
            and len(plain) == len(shape.get("added_tokens", []))
        )
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = "H" if self.size <= 1 << 16 else "I"
        self.joined = shape.get("decoder") is None
        suffix = shape.get("model", {}).get("end_of_word_suffix")
        #: Which ids end a word, if the vocabulary tells them apart.
        self.last = np.array([bool(suffix) and (self.lib.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])
        self.seen = Remembered(self.word)
        self.bare = Remembered(self._library)

    def _library(self, word: str) -> bytes:
        return array.array(self.kind, self.lib.encode(word, add_special_tokens=False).ids).tobytes()

    #: A Latin word of letters, then marks that the tokenizer keeps as one run.
    _letters, _marks = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?|#*$%&]*"
    _simple = re.compile(f"({_letters})({_marks})")

    def word(self, word: bytes) -> bytes:
        """Ids of one piece without ASCII white space."""
        text = word.decode("utf-8")
        m = self._simple.fullmatch(text)
        if m is None:
            return self._library(text)
        return self.bare[m[1].lower()] + (self.bare[m[2]] if m[2] else b"")

    def _learn(self, words: list[str], letters: int) -> list[bytes]:
        """Ids of distinct pieces, of which the first ones are runs of letters in lower case: these go to the library together."""
        known = [self.bare.get(w) for w in words]
        new = [k for k, x in enumerate(known) if x is None]
        if len(self.bare) + len(new) > self.bare.most:
            self.bare.clear()
        joint = [k for k in new if k < letters]
        for part in (joint[at : at + TOGETHER] for at in range(0, len(joint), TOGETHER)):
            ids = np.array(self.lib.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                flat, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
                for k, s, e in zip(part, [0, *ends], ends, strict=False):
                    known[k] = flat[s:e]
        for k in new:
            if known[k] is None:
                known[k] = self._library(words[k])
        for k in new[: self.bare.most]:
            self.bare[words[k]] = known[k]
        return known

    def column_ids(self, column: pa.Array) -> Iterator[bytes]:
        """What `ids` gives for each text of a column, null as empty. Distinct words of some MB of texts are looked up once."""
        if not self.by_word:
            yield from (self._library(x or "") for x in column.to_pylist())
            return
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        cuts = np.flatnonzero(np.diff(ends // CUT_BYTES)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True):
            yield from self._cut(column.slice(s, e - s))

    def _cut(self, column: pa.Array) -> Iterator[bytes]:
        words = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = words.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, f"^(?P<letters>{self._letters})(?P<marks>{self._marks})$")
        simple = np.asarray(parts.is_valid())
        letters, marks = (parts.field(k).filter(pa.array(simple)) for k in range(2))
        units = pa.concat_arrays([pc.utf8_lower(letters), marks, coded.dictionary.filter(pa.array(~simple))]).dictionary_encode()
        codes, n = np.asarray(units.indices), len(letters)
        known = self._learn(units.dictionary.to_pylist(), int(codes[:n].max(initial=-1)) + 1)
        flat = np.frombuffer(b"".join(known), self.kind)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // flat.itemsize
        # Words as letters, then marks, and all others as they are; then texts as words.
        of = np.full((len(simple), 2), len(known), np.int64)
        of[simple, 0], of[simple, 1], of[~simple, 0] = codes[:n], codes[n : 2 * n], codes[2 * n :]
        flat, ends = _gathered(flat, np.r_[sizes, 0], of.ravel())
        flat, ends = _gathered(flat, np.diff(ends[::2]), np.asarray(coded.indices))
        of_text = ends[np.asarray(words.offsets) - words.offsets[0].as_py()].tolist()
        yield from (flat[s:e].tobytes() for s, e in zip(of_text[:-1], of_text[1:], strict=True))

    def forget(self) -> None:
        """Let go of what was remembered, so that a worker that waits for other work holds little."""
        self.seen.clear()
        self.bare.clear()

    def ids(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._library(text.decode("utf-8"))
        return b"".join(map(self.seen.__getitem__, text.split()))


def _gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of these numbers one after the other, and where each begins and ends; `flat` holds the pieces of these sizes in order."""
    each = sizes[at]
    ends = np.r_[0, np.cumsum(each)]
    begins = np.cumsum(sizes) - sizes
    return flat[np.repeat(begins[at] - ends[:-1], each) + np.arange(ends[-1])], ends


def file_bytes(path: str) -> tuple[bytes, str]:
    """A tokenizer file's bytes, a few MB at most, and their digest, which names its version."""
    import hashlib

    with open(path, "rb") as f:
        data = f.read(64 << 20)
        if f.read(1):
            raise ValueError(f"{path} is larger than a tokenizer file may be")
    return data, hashlib.sha256(data).hexdigest()
