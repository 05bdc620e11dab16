"""Token ids by the tokenizers library, each distinct chunk of text encoded once."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import regex

from .chunks import ChunkEncoder, DistinctChunkEncoder, Index

CHUNKS_PER_CALL = 2000
#: Chunks, and words, kept at most.
KNOWN = 500_000

_NUMBER = regex.compile(r"\p{N}")
#: In front of a chunk without digits this is a token of its own.
_MARK = " 0"
#: Both pre-tokenizers end a run of letters before these, and keep them together.
SIGNS = ".,!#*$%&"
#: Letters that do not join with each other under normalization.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_WORD = re.compile(f"([ \\n]?)([{_LETTERS}]+)")
_EVERY = "".join(filter(re.compile(f"[{_LETTERS}]").fullmatch, map(chr, range(0x180))))


class _Words:
    """Words encoded so far: their numbers, and their runs in one array of ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.flat = np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _words_of(tokenizer) -> Callable[[str], list[int] | None]:
    """Ids of a word of ``_LETTERS``, with a space, a line end or nothing before it, from the
    tokenizer's model alone; None for other texts.

    Most of the time of a new word is spent before the model sees it. What the model then
    sees is known letter by letter: each is asked of the normalizer and the pre-tokenizer
    once, and one word of all letters must come out as those joined. Where it does not, or
    an added token could lie within a word, no word is asked directly.
    """
    model = tokenizer.model

    def pieces(text: str) -> list[str]:
        if tokenizer.normalizer:
            text = tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    def run(piece: str) -> list[int]:
        return [token.id for token in model.tokenize(piece)]

    seen = {ord(c): "".join(pieces(c)) for c in _EVERY}
    every = _EVERY.translate(seen)
    # What comes before a word: ids of pieces of their own, and what is joined to the word.
    leads: dict[str, tuple[list[int], str]] = {}
    if not any(set(t.content) <= set(_EVERY + " \n") for t in tokenizer.get_added_tokens_decoder().values()):
        for lead in ("", " ", "\n"):
            *before, last = pieces(lead + _EVERY)
            if last.endswith(every):
                leads[lead] = ([i for p in before for i in run(p)], last.removesuffix(every))

    def ids(text: str) -> list[int] | None:
        found = _WORD.fullmatch(text)
        if not found or found[1] not in leads:
            return None
        before, joined = leads[found[1]]
        return before + run(joined + found[2].translate(seen))

    return ids


@lru_cache(maxsize=2)
def encoder(definition: str) -> ChunkEncoder:
    """Encoder for a tokenizer's JSON definition; kept by the worker between tasks, with
    its bounded table of words.

    As the library does by default, the string of a special token in a text becomes
    that token. Words of plain letters are asked of the tokenizer's model. Of the others
    many go into one call, a mark before each; chunks with digits, which could grow into
    the mark, are encoded one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    mark = tokenizer.encode(_MARK, add_special_tokens=False).ids

    def singly(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for run in runs for i in run], np.int32), np.array([len(r) for r in runs], np.int64)

    def together(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = _MARK + _MARK.join(texts)
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        marks = ids == mark[0]
        at = np.flatnonzero(marks) if len(mark) == 1 else []
        if len(at) != len(texts):
            return singly(texts)
        return ids[~marks], np.diff(np.append(at, len(ids))) - 1

    words, word_ids = _Words(), _words_of(tokenizer)

    def learn() -> None:
        """Encode the words met for the first time."""
        new, words.index.new = words.index.new, []
        if not new:
            return
        order: list[int] = []
        rest: list[int] = []
        flat, counts = array("i"), []
        for i, text in enumerate(new):
            run = word_ids(text)
            if run is None:
                rest.append(i)
            else:
                order.append(i)
                counts.append(len(run))
                flat.extend(run)
        found = [(np.array(flat, np.int32), np.array(counts, np.int64))]
        odd = [i for i in rest if _NUMBER.search(new[i]) or new[i][-1:].isspace()]
        apart = set(odd)
        plain = [i for i in rest if i not in apart]
        found += [together([new[i] for i in plain[k : k + CHUNKS_PER_CALL]]) for k in range(0, len(plain), CHUNKS_PER_CALL)]
        if odd:
            found.append(singly([new[i] for i in odd]))
        order += plain + odd
        flat, counts = (np.concatenate(x) for x in zip(*found))
        # Where each word's run lies; runs are in the order they were encoded in.
        starts = np.empty(len(new), np.int64)
        starts[order] = np.cumsum(counts) - counts + len(words.flat)
        sizes = np.empty(len(new), np.int64)
        sizes[order] = counts
        words.flat = np.concatenate([words.flat, flat])
        words.starts = np.concatenate([words.starts, starts])
        words.sizes = np.concatenate([words.sizes, sizes])

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(words.index) > KNOWN:
            words.clear()
        # Signs after a word are tokens of their own, so words are encoded without.
        parts: list[str] = []
        pairs: list[int] = []
        for i, (text, word) in enumerate(zip(texts, [t.rstrip(SIGNS) for t in texts])):
            if word is not text and word and word[-1].lower()[-1].isalpha():  # a capital I with a dot ends in the dot
                parts += (word, text[len(word) :])
                pairs.append(i)
            else:
                parts.append(text)
        numbers = np.fromiter(map(words.index.__getitem__, parts), np.int64, len(parts))
        learn()
        sizes = words.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.starts[numbers] - ends + sizes, sizes)
        each = np.ones(len(texts), np.int64)
        each[pairs] = 2
        return words.flat[at], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])].astype(np.int64)

    return DistinctChunkEncoder(encode, KNOWN, words.clear)
