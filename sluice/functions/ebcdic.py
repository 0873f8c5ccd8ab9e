"""EBCDIC code page 1047, made from code page 37, which Python has, by the characters in which they differ."""

from __future__ import annotations

# Bytes at which code page 1047 differs from 37, and their characters.
_DIFFERENT = {0x15: "\n", 0x25: "\x85", 0x5F: "^", 0xAD: "[", 0xB0: "¬", 0xBA: "Ý", 0xBB: "¨", 0xBD: "]"}
TABLE = "".join(_DIFFERENT.get(b, bytes([b]).decode("cp037")) for b in range(256))
_BACK = {c: b for b, c in enumerate(TABLE)}
SPACE = 0x40


def decode(data: bytes) -> str:
    return "".join(TABLE[b] for b in data)


def encode(text: str) -> bytes:
    return bytes(_BACK[c] for c in text)
