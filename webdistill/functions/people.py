"""Lists of people in one text."""

from __future__ import annotations

import re

_SPLIT = re.compile(r"[,;]|\s+and\s+|\s+&\s+")
_LEAD = re.compile(r"^(?:and|&)\s+|^(?:by|von|par|por)\s+", re.I)
# Small words within names, words after names, and words that no person's name has.
PARTICLES = frozenset("al bin da de del der di du la le ten van von y".split())
CREDENTIALS = frozenset("bsc cpa dds dnp dvm edd esq facc facs frcp ii iii iv jd jr mba md mph msc pharmd phd psyd rn sr".split())
ORGANISATIONS = frozenset(
    "agency associated associates association board bureau co college company corp correspondent council department desk developer director editor editors engineer foundation gmbh group inc "
    "institute llc llp ltd manager media news newsroom officer partners press redaktion reporter reporters research school service services society staff studio team times university writer writers".split()
)


def is_person(part: str) -> bool:
    """Whether a text has the form of a full name: two to four capitalised words, small words between, nothing of an organisation."""
    words = part.split()
    names = [w for w in words if w not in PARTICLES]
    if not 2 <= len(names) <= 4 or len(words) > 6 or words[-1] in PARTICLES or any(c.isdigit() for c in part):
        return False
    return all(w[0].isupper() and all(c.isalpha() or c in ".'’-" for c in w) for w in names) and not any(w.strip(".").lower() in ORGANISATIONS for w in words)


def is_credentials(part: str, capitals: bool) -> bool:
    """Whether all words qualify a name: ``MD``, ``Ph.D.``, ``Jr``."""
    bare = [w.rstrip(".,") for w in part.split()]
    return bool(bare) and all(w.lower() in CREDENTIALS or "." in w or not capitals and 2 <= len(w) <= 5 and w.isascii() and w.isalpha() and w.isupper() for w in bare)


def people(value: str) -> tuple[list[str], bool]:
    """The people that a text lists, and whether that is sure; none if it is one name.

    Two parts without a semicolon may be one name turned round, or a firm, so they aren't sure.
    """
    parts = [p for x in _SPLIT.split(value.strip()) if (p := _LEAD.sub("", _LEAD.sub("", x.strip())).strip())]
    capitals = not any(c.islower() for c in value)
    if not 2 <= len(parts) <= 10 or not all(map(is_person, parts)) or any(is_credentials(p, capitals) for p in parts):
        return [], False
    return parts, len(parts) > 2 or ";" in value
