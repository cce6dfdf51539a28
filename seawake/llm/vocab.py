"""Reading a public SentencePiece vocabulary; the file's bytes are read by the driver and shipped to the tasks."""

from __future__ import annotations

from pathlib import Path

import sentencepiece

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


def read_model(path: str = MODEL) -> bytes:
    """The vocabulary file (half a megabyte; a vocabulary does not grow with the corpus)."""
    return Path(path).read_bytes()


def pieces(model: bytes) -> tuple[dict[str, tuple[int, float]], list[int]]:
    """The normal pieces with id and score, and the ids of the 256 byte pieces."""
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    normal, of_byte = {}, [-1] * 256
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            of_byte[int(p[1:-1], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            normal[p] = (i, m.get_score(i))
    return normal, of_byte
