"""Words of the contracts that lower-case A-Z and take runs of digits, letters a-z and everything beyond ASCII."""

from __future__ import annotations

import re

#: on UTF-8 bytes: what [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ takes on characters
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []
