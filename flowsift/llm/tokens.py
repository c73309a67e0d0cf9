"""Token counts and token ids of whole texts with a public tokenizer.

Counts: texts up to ``CHUNK`` code points are encoded by words.  A longer one is
encoded in chunks that overlap.  In the overlap both encodings must agree on
a boundary that is proven stable: both have a token that ends there and one
that starts after white space, which no token of the tokenizer spans.  The
chunks are spliced there.  Where an overlap holds no such place it is doubled,
up to the whole text.

Ids: texts are split at ASCII white space, which the tokenizer drops and never
joins over, so every word's ids can be looked up among those seen before.  Arrow
splits a group of texts, finds its distinct words and puts their ids together;
only distinct words are looked up in Python.  A word's ids are those of its
letters and those of the ASCII punctuation after them, so a word that is known
with other punctuation is not encoded again.

Null texts are empty and have no tokens.  Special tokens that occur in a text
are read as the tokenizer's default does.  Empty tables give empty results.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may follow a word without changing its own tokens.
_PUNCTUATION = string.punctuation.encode()

CHUNK = 16_384
OVERLAP = 512
#: Words whose ids a worker remembers before it forgets those not in use (about 200 bytes each).
WORDS_KEPT = 600_000
#: Bytes of the texts that are split and looked up together; a longer text is alone.
GROUP = 8_000_000
LIMIT = 2048


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizer's file is; the box's own copy is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _spans(tokenizer, text: str, at: int) -> list[tuple[int, int]]:
    """Start and end of each token, counted from the start of the document."""
    return [(a + at, b + at) for a, b in tokenizer.encode(text, add_special_tokens=False).offsets]


def _stable(text: str, spans: list[tuple[int, int]], low: int, high: int) -> set[int]:
    """Starts of tokens in [low, high) before which white space was dropped."""
    return {a for a, _ in spans if low <= a < high and text[a - 1] in " \t\n\x0b\x0c\r"}


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, by overlapping chunks."""
    n, total, at, begin = len(text), 0, 0, 0
    left = _spans(tokenizer, text[:chunk], 0)
    while at + chunk < n:
        end, width, splice = at + chunk, overlap, None
        while splice is None:
            start = max(end - width, begin)
            right = _spans(tokenizer, text[start:start + max(chunk, 2 * width)], start)
            common = _stable(text, left, start + 1, end) & _stable(text, right, start + 1, end)
            if common:
                splice = max(common)
            elif start == begin:  # nothing to splice at in the whole chunk: take a longer one
                chunk_end = min(n, end + max(chunk, width))
                left, end, width = _spans(tokenizer, text[begin:chunk_end], begin), chunk_end, overlap
                if end == n:
                    return total + sum(a >= begin for a, _ in left)
            else:
                width *= 2
        total += sum(begin <= a < splice for a, _ in left)
        left, at, begin = right, start + max(chunk, 2 * width) - chunk, splice
    return total + sum(a >= begin for a, _ in left)


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        for batch in batches:
            texts = batch.column("text")
            counts = np.zeros(len(texts), dtype=np.int64)
            short = pc.less_equal(pc.utf8_length(texts), CHUNK)
            for i, ids in zip(np.flatnonzero(short), ids_of(texts.filter(short))):
                counts[i] = len(ids)
            for i in np.flatnonzero(pc.invert(short)):
                counts[i] = count_spliced(ids_of.tokenizer, texts[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _letters(word: bytes) -> bool:
    """Letters only; the last one is a letter since an early Unicode, which every tokenizer's tables know."""
    if word.isalpha():  # of ASCII
        return True
    text = word.decode()
    return text.isalpha() and unicodedata.ucd_3_2_0.category(text[-1])[0] == "L"


def _remembered(path: str) -> dict[bytes, bytes]:
    """What a worker has learnt outlives its tasks: this package is shipped by value, an installed module stays."""
    import tokenizers

    return vars(tokenizers).setdefault("_flowsift_words", {}).setdefault(path, {})


class WordIds:
    """Token ids of texts by words; remembers the words it has seen.

    Words new to a group of texts are encoded in one go, and where too many are
    known by then, those that the group does not hold are forgotten.  Letters
    alone are one piece of the tokenizer: joined by spaces, each ends where a
    token closes a piece.  Between other words stands a special token.  A text
    that may hold special tokens itself is encoded as it is.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT, group: int = GROUP):
        self.tokenizer, self.kept, self.group, self.known = load(path), kept, group, _remembered(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.separator = max(special)
        self.between = special[self.separator].content
        self.marks = [t.content for t in special.values()]
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Ids of each word: up to its end, the next word's after ``gap`` more."""
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *(e + 4 * gap for e in ends)], ends))))

    def _learn(self, words: list[bytes]) -> None:
        letters, tailed, others = set(), [], []
        for word in words:
            core = word if word.isalpha() else word.rstrip(_PUNCTUATION)
            if not _letters(core):
                others.append(word)
                continue
            letters.add(core)
            if len(core) < len(word):  # punctuation is a piece of its own after a letter only
                tailed.append((word, core, word[len(core):]))
        self._learn_letters(list(letters.difference(self.known)))
        self._learn_any(list({tail for _, _, tail in tailed}.difference(self.known)))
        for word, core, tail in tailed:
            self.known[word] = self.known[core] + self.known[tail]
        self._learn_any(others)

    def _learn_letters(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            ids = self._ids(b" ".join(part).decode())
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._keep(part, ids, ends, 0)
            else:  # not every word is one piece
                self._learn_any(part)

    def _learn_any(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            ids = self._ids(self.between.join(w.decode() for w in part))
            ends = np.flatnonzero(ids == self.separator)
            if len(ends) == len(part) - 1:
                self._keep(part, ids, np.append(ends, len(ids)), 1)
                continue
            for word in part:  # one brought separators of its own
                self.known[word] = self._ids(word.decode()).tobytes()

    def _groups(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Neighbours of up to ``group`` bytes in all, or one text."""
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + self.group, side="right")))
            yield texts[at:end]
            at = end

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these distinct words."""
        ids = list(map(self.known.get, words))
        if len(self.known) > self.kept:
            used = {word: own for word, own in zip(words, ids) if own is not None}
            self.known.clear()
            self.known.update(used)
        self._learn([word for word, own in zip(words, ids) if own is None])
        return [self.known[word] if own is None else own for word, own in zip(words, ids)]

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        for some in self._groups(texts):
            lowered = pc.ascii_lower(some)  # only A-Z change, and only ASCII space splits
            odd = np.zeros(len(some), dtype=bool)
            for mark in self.marks:
                odd |= pc.match_substring(lowered, mark.lower()).to_numpy(zero_copy_only=False)
            if odd.any():
                lowered = pc.if_else(pa.array(odd), pa.scalar("", lowered.type), lowered)
            split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lowered))
            ends = split.offsets.to_numpy()
            words = split.flatten().dictionary_encode()
            distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            known = pa.array(self._known(distinct), pa.large_binary())
            # ids in the order of the words, whatever the size
            ids = known.take(words.indices)
            _, at, raw = ids.buffers()
            cuts = (np.frombuffer(at, dtype="<i8", count=len(ids) + 1)[ends] // 4).tolist()
            flat = np.frombuffer(raw or b"", dtype="<u4", count=cuts[-1])
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                yield self._whole(some[i].as_py()) if odd[i] else flat[a:b]
