"""Loading public tokenizers from a path given as parameter."""

from __future__ import annotations

import functools
import json
import os

#: Pre-tokenizer pattern of byte-level BPE (fixed value of the file format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for the 256 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str):
    """`text -> ids` equal to the tokenizers library's for a byte-level BPE file, special strings included.

    Files of the plain shape (ids in merge order, no normalizer, the usual pattern) run on tiktoken, which
    gives the same ids several times faster; any other file runs on the tokenizers library itself, and so does
    a text on which tiktoken's regular expressions give up (white space of some hundred thousand characters).
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        and pre.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges")
    )
    if plain:
        import tiktoken

        alphabet, special = _byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        in_order = all(model["vocab"][m.replace(" ", "")] == 256 + i for i, m in enumerate(merged))
        simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        if in_order and simple:
            fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

            def encode(text: str) -> list[int]:
                try:
                    return fast.encode(text, allowed_special="all")
                except ValueError:
                    return _library(path)(text)

            return encode
    return _library(path)


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return lambda text: slow.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """The sentencepiece model at `path`."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
