"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame

from lumaframe.functions.arrow import flat_map_rows

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the word pattern these byte-level vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def make_counter(path: str) -> Callable[[str], int]:
    """A function from text to its number of tokens; special tokens count as text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text))
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def token_counts(docs: DataFrame, *keep: str, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """(doc_id, tokens, ...keep) of every document; null and empty texts have 0 tokens."""

    def make() -> Callable[..., list[tuple]]:
        count = make_counter(tokenizer)

        def size(doc_id: int | None, text: str | None, *rest: object) -> list[tuple]:
            text = (text or "").encode("utf-8", "replace").decode()
            return [(doc_id, count(text) if text else 0, *rest)]

        return size

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "doc_id bigint, tokens bigint" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return flat_map_rows(docs, ["doc_id", "text", *keep], make, schema)
