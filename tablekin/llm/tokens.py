"""Token ids of whole texts by a public tokenizer, each different word encoded once per worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
CACHE = 200_000
#: Texts encoded at a time.
TOKEN_SLICE = 1024
#: A word of its own between the words that are encoded together.
MARK = "\x01"
_TAIL = "([a-z\u00e0-\u00f6\u00f8-\u00ff])([.,])( |$)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Ids:
    """Ids of texts as arrays of unsigned 32-bit integers.

    The tokenizer never joins what blanks or line feeds separate, so a text's ids are those of its words in a row.
    It ignores case, and one full stop or comma after a letter and before a blank is a piece of its own: words are
    looked up in lower case and without these. Words met before are kept, up to CACHE of them; then those met in one
    call only go. New ones are encoded by the tokenizers library, many at a time, with a mark between them. In lower-case Latin-1 the tokenizer's normalizer changes
    nothing, and is left out; all other words pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.encoder.model)  # shares the model
        self.plain.pre_tokenizer = self.encoder.pre_tokenizer
        self.vocabulary = self.encoder.get_vocab_size()
        self.known: dict[str, bytes] = {"": b""}
        self.mark = int.from_bytes(self._alone(MARK), "little")
        self.again: set[str] = set()
        if len(self._alone(MARK)) != 4:
            raise ValueError("the mark must be a single token")

    def _alone(self, word: str) -> bytes:
        return np.array(self.encoder.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[str], encoder) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(encoder.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                out.update((w, self._alone(w)) for w in part)
                continue
            raw = ids.tobytes()
            bounds = [0, *((ends + 1) * 4).tolist(), len(raw) + 4]
            out.update((w, raw[bounds[k] : bounds[k + 1] - 4]) for k, w in enumerate(part))
        return out

    def learn(self, words: list[str]) -> None:
        plain, odd, known = [], [], self.known
        for w in words:
            if latin(w) and MARK not in w and "<|" not in w and w == w.lower():
                plain.append(w)
            else:
                odd.append(w)
        known.update(self._encode(plain, self.plain))
        known.update(self._encode([w for w in odd if MARK not in w], self.encoder))
        known.update((w, self._alone(w)) for w in odd if MARK in w)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Words are told apart by Arrow, and Python sees each different word of the call once."""
        plain = pc.replace_substring_regex(pa.array([canonical(t) for t in texts], pa.string()), _TAIL, r"\1 \2\3")
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        met = self.known.keys() & words
        self.again |= met
        if len(self.known) > CACHE:
            if len(self.again) > CACHE * 2 // 3:
                self.again = met
            self.known = {w: self.known[w] for w in self.again} | {"": b""}
            self.again = set()
        if len(met) < len(words):
            self.learn([w for w in words if w not in met and w])
        values = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        begin = np.cumsum(size) - size
        each = size[index]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[index] - (ends - each), each) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def canonical(text: str | None) -> str:
    """Blanks for line feeds, and Latin-1 texts in lower case."""
    if not text:
        return ""
    text = text.replace("\n", " ")
    return text.lower() if latin(text) and "<|" not in text and MARK not in text else text


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LOADED: dict[str, Ids] = {}


def loaded(path: str) -> Ids:
    """The tokenizer of this worker, read once."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]
