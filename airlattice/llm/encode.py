"""Token ids of texts, exactly as the tokenizers library gives them, with words encoded once.

A text may be cut before any ASCII space that follows a character which is not white space: the
tokenizer's own word pattern never spans such a place, so the ids of the parts put together are the
ids of the whole. Parts repeat a lot, so each worker keeps those it has met, in two generations of
bounded size, and the library only sees new ones.
"""

import os
import re
from array import array

from pyspark.sql import SparkSession
from tokenizers import Tokenizer

# Words kept per generation (about 220 bytes each), bytes that say which were met, and texts handled at once.
KEPT_WORDS = 150_000
SEEN = 1 << 20
SLICE = 250
_SPLIT = re.compile(r"(?<=\S) ")
_UNSAFE = re.compile(r"\s ")
# Parts of letter runs, points and line ends fall apart into those whatever the context: they are
# different kinds of characters to the tokenizer, and none of them is an apostrophe.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_POINTS = ".,;:!?"
_SIMPLE = re.compile(f"[{_LETTERS}]+[{_POINTS}]*(?:\n[{_LETTERS}]+[{_POINTS}]*)*")
_RUNS = re.compile(f"[{_LETTERS}]+|[{_POINTS}]+|\n")


class _Parts(dict):
    """Ids of parts, which learns others as they are looked up and keeps those that it met twice: most parts
    of a corpus never come again. Bytes by hash say which came before; a shared one only keeps a part too early."""

    def __init__(self, learn, older=()):
        super().__init__()
        self.learn, self.older, self.met = learn, older, bytearray(SEEN)

    def __missing__(self, part: str) -> bytes:
        if part in self.older:
            ids = self[part] = self.older[part]
            return ids
        ids = self.learn(part)
        at = hash(part) % SEEN
        if self.met[at]:
            self[part] = ids
        else:
            self.met[at] = 1
        return ids


class WordEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes. Special tokens' strings in a text get
    their id and nothing is added, truncated or padded: the library's behaviour without options."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # Whether a space belongs to the word after it, or is dropped.
        self.spaces_count = self._ids([" a"]) != self._ids(["a"])
        self.lowers = self._ids(["A"]) == self._ids(["a"])
        # Parts after a space (newer and older), and parts at the start of a text or inside a part.
        self.words = _Parts(self._learned)
        self.heads = _Parts(self._head) if self.spaces_count else self.words
        self.prefix = " " if self.spaces_count else ""
        self.letters = self._plain_letters()

    def _plain_letters(self) -> dict | None:
        """How a letter is written in the vocabulary, None if letter runs need the whole tokenizer."""
        parts = self.tokenizer.pre_tokenizer
        written = {c: parts.pre_tokenize_str(chr(c))[0][0] for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)}
        tried = ["wordsÀÉßÿ", "Wordéà"]
        self.space_sign = parts.pre_tokenize_str(" a")[0][0][:-1] if self.spaces_count else ""
        self.letters = written
        plain = [self._run(self.prefix + t) for t in tried] == self._ids([self.prefix + t for t in tried])
        return written if plain else None

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", encoding.ids).tobytes() for encoding in found]

    def _run(self, run: str) -> bytes:
        """Ids of a run of plain letters: one word for the model, straight from it."""
        word = run.lower() if self.lowers else run
        sign = ""
        if word[0] == " ":
            sign, word = self.space_sign, word[1:]
        if not word.isascii():
            word = word.translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(sign + word)]).tobytes()

    def _cut(self, text: str) -> list[str]:
        if self.spaces_count and _UNSAFE.search(text):
            return _SPLIT.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        word, head = self.words.__getitem__, self.heads.__getitem__
        found = []
        for text in texts:
            first, *rest = self._cut(text)
            found.append(head(first) + b"".join(map(word, rest)))
        if len(self.words) > KEPT_WORDS:
            self.words.older = ()
            self.words = _Parts(self._learned, self.words)
            if not self.spaces_count:
                self.heads = self.words
        if len(self.heads) > KEPT_WORDS:
            self.heads.older = ()
            self.heads = _Parts(self._head, self.heads)
        return found

    def _head(self, part: str) -> bytes:
        if self.letters is not None and part and _RUNS.fullmatch(part) and part[0].isalpha():
            return self._run(part)
        return self._ids([part])[0]

    def _learned(self, part: str) -> bytes:
        if self.letters is not None:
            # Most parts are a run of letters, or one with a point.
            if part.isascii():
                if part.isalpha():
                    return self._run(self.prefix + part)
                if part[-1:] in _POINTS and part[:-1].isalpha():
                    return self.words[part[:-1]] + self.heads[part[-1]]
            if _SIMPLE.fullmatch(part):
                return self._composed(part)
        return self._ids([self.prefix + part])[0]

    def _composed(self, part: str) -> bytes:
        runs = _RUNS.findall(part)
        if len(runs) == 1:
            return self._run(self.prefix + part)
        return b"".join([self.words[runs[0]], *map(self.heads.__getitem__, runs[1:])])


_encoders: dict = {}


def encoder(vocabulary) -> WordEncoder:
    """The worker's encoder of a broadcast vocabulary: workers outlive tasks, and so do its words."""
    if vocabulary.value not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.value] = WordEncoder(vocabulary.value)
    return _encoders[vocabulary.value]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read where the job is planned and broadcast: a fixed size for any corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def batch_slices(batch, size: int = SLICE):
    """An Arrow batch in steps, so that few of its texts are held as strings at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)
