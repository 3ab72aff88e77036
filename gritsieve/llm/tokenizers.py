"""Public tokenizers, loaded once in each Python worker from the folder of their vocabulary files."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import sentencepiece
import tiktoken

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def byte_bpe(name: str = BYTE_BPE, folder: str = FOLDER) -> tiktoken.Encoding:
    """A byte-level vocabulary from a file of ranks."""
    ranks = {}
    for line in (Path(folder) / name).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_bpe(name: str = PIECE_BPE, folder: str = FOLDER) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """A vocabulary of pieces with byte fallback, and which of its ids are bytes other than white space."""
    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / name))
    blank = {f"<0x{b:02X}>" for b in (9, 10, 11, 12, 13, 32)}
    is_byte = np.array([model.is_byte(i) and model.id_to_piece(i) not in blank for i in range(model.vocab_size())])
    return model, is_byte
