import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return [w.decode() for w in WORD.findall(raw)]
