"""Byte-level BPE of whole texts, with the ids of recurring chunks remembered.

The pre-tokenizer's pattern ` ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` always begins a new piece at a
space that precedes a character other than white space. So a text may be cut before each such space and the
chunks encoded apart. A text in which a space precedes white space or the end is encoded in one go.

The vocabulary is the tokenizers library's JSON file. Where its ids follow its list of merges, which is checked
on loading, chunks are encoded by tiktoken's faster core from the same vocabulary; otherwise by the tokenizers
library itself. A text that holds the string of an added token, which the library gives that token's id, is
encoded by the library as a whole.
"""

import json
import os
from functools import cache

import numpy as np

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_LIMIT = 500_000


class Chunks(dict):
    """Ids of chunks that follow a space, by chunk. What has not been asked for lately is forgotten."""

    def __init__(self, encode, dtype):
        super().__init__()
        self.encode, self.dtype, self.older = encode, dtype, {}

    def __missing__(self, chunk):
        ids = self.older.get(chunk)
        if ids is None:
            if not chunk or chunk[0].isspace():
                raise LookupError("a space before white space or the end")
            ids = np.array(self.encode(" " + chunk), dtype=self.dtype).tobytes()
        self[chunk] = ids
        return ids

    def forget(self):
        if len(self) > CHUNK_LIMIT:
            self.older = dict(self)
            self.clear()


class ByteBpe:
    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.encode_one = ranked_encoder(path) or self.library_ids
        self.chunks = Chunks(self.encode_one, self.dtype)

    def library_ids(self, text):
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text):
        """Little-endian ids of one text; null counts as empty."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return np.array(self.library_ids(text), dtype=self.dtype).tobytes()
        first, *rest = text.split(" ")
        self.chunks.forget()
        try:
            found = list(map(self.chunks.__getitem__, rest))
        except LookupError:
            return np.array(self.encode_one(text), dtype=self.dtype).tobytes()
        if first:
            found.insert(0, np.array(self.encode_one(first), dtype=self.dtype).tobytes())
        return b"".join(found)


def byte_alphabet():
    """The characters that stand for bytes: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked_encoder(path):
    """tiktoken's encoder of the JSON vocabulary, or None where ids do not follow the merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {token["content"] for token in spec["added_tokens"]}
    first = len(vocabulary.keys() - special) - len(pairs)
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or first != 256:
        return None
    if any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
        return None
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def byte_bpe(path):
    """One encoder per worker process and vocabulary file."""
    return ByteBpe(path)


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
