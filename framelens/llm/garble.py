"""Recognising and undoing text that was decoded with the wrong character encoding (pure Python, one text at a time).

A *run* is a maximal stretch of non-ASCII characters. A run is garbled under a pair (wrong, true) if writing it
with the wrong codec and reading it with the true one succeeds without loss and gives characters of the scripts that news
text uses. For the multi-byte codec UTF-8 a strict success is next to proof; for the others the result must also look
like words of one script.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

# --- fixed values: the codecs tried, first the wrong ones under which UTF-8 is misread, then other pairs ------------
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "koi8-r", "cp866", "mac_cyrillic")
LEGACY_PAIRS = (
    ("cp1252", "gb18030"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8-r"),
    ("cp1252", "cp1256"),
    ("cp1252", "cp874"),
    ("cp1252", "euc_jp"),
    ("cp1252", "euc_kr"),
    ("cp1252", "big5"),
)
CYRILLIC_SWAPS = (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_cyrillic", "cp1251"))
#: Characters that Russian text in its own right puts next to capital letters, so they prove nothing under cp1251.
ORDINARY_CYRILLIC_COMPANY = set("«»…—–“”„‘’№ёЁ·•€™©®§°± ")

RUN = re.compile(r"[^\x00-\x7f]+")
CYRILLIC = re.compile("[А-я]")
BYTES_AS_TEXT = re.compile("[‚ƒ\x81-\x9f]")
ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,5});")
SHIFT_JIS = re.compile(r"(?:[\x81-\x9fƒ‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\xe0-\xfc][\x40-\x7e\x80-\xffĀ-™])+")
SWAPPED_CASE = re.compile(r"\b[а-яё][А-ЯЁ]{2,}\b")


def _table(codec: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b  # bytes that the codec leaves undefined pass through as control characters
    return table


_TABLES = {c: _table(c) for c in {*UTF8_READ_AS, *(p[0] for p in (*LEGACY_PAIRS, *CYRILLIC_SWAPS))}}


#: A run that begins with another character comes out of no single-byte codec.
_KNOWN = frozenset(ch for t in _TABLES.values() for ch in t) | frozenset(map(chr, range(0x80, 0xA0)))


def to_bytes(run: str, codec: str) -> bytes | None:
    table, out = _TABLES[codec], bytearray()
    for ch in run:
        if ch < "\x80":
            out.append(ord(ch))
        elif (b := table.get(ch)) is not None:
            out.append(b)
        elif codec == "cp1252" and "\x80" <= ch <= "\x9f":
            out.append(ord(ch))
        else:
            return None
    return bytes(out)


def plausible(ch: str) -> bool:
    """A character that clean news text holds: letters of the scripts in use, their marks, and common symbols."""
    o = ord(ch)
    return (
        o < 0x80
        or 0xA0 <= o <= 0x17F
        or 0x0300 <= o <= 0x036F
        or 0x0400 <= o <= 0x045F
        or 0x0600 <= o <= 0x06FF
        or 0x0900 <= o <= 0x097F
        or 0x0E00 <= o <= 0x0E7F
        or 0x1200 <= o <= 0x139F
        or 0x2010 <= o <= 0x2044
        or 0x20A0 <= o <= 0x20BF
        or o in (0x2116, 0x2122, 0x200B, 0x200D, 0x0391, 0x2190, 0x2192, 0x2212, 0xFE0F)
        or 0x2500 <= o <= 0x25FF
        or 0x3000 <= o <= 0x30FF
        or 0x4E00 <= o <= 0x9FFF
        or 0xAC00 <= o <= 0xD7A3
        or 0xFF00 <= o <= 0xFFEF
        or 0x1F300 <= o <= 0x1FAFF
    )


def script(ch: str) -> str:
    o = ord(ch)
    for name, lo, hi in (("cyrillic", 0x400, 0x45F), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("ethiopic", 0x1200, 0x139F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3)):
        if lo <= o <= hi:
            return name
    return "latin" if ch.isalpha() else ""


@lru_cache(maxsize=200_000)
def utf8_misread(run: str) -> tuple[str, str] | None:
    """(wrong codec, text as written) of a run that is UTF-8 read with a single-byte codec, or None."""
    if len(run) < 2 or run[0] not in _KNOWN:
        return None
    for codec in UTF8_READ_AS:
        raw = to_bytes(run, codec)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(text) >= len(run):
            continue
        if not all(map(plausible, text)):
            if (deeper := utf8_misread(text)) is None:
                continue
            text = deeper[1]  # garbled twice
        if codec in ("cp1251", "mac_cyrillic", "koi8-r", "cp866") and not (set(run) - ORDINARY_CYRILLIC_COMPANY - set(map(chr, range(0x410, 0x450)))):
            continue
        if codec in ("koi8-r", "cp866") and not (set(map(script, text)) & {"cyrillic"} or len(run) >= 3):
            continue
        return codec, text
    return None


def _words_of(text: str, kinds: set[str], least: float) -> bool:
    letters = [script(c) for c in text if c.isalpha()]
    return bool(letters) and sum(s in kinds for s in letters) >= least * len(letters)


def _common_gb(raw: bytes) -> bool:
    """Everyday Chinese: nearly all pairs of bytes are of the first level of the standard, or its punctuation."""
    pairs = list(zip(raw[::2], raw[1::2]))
    return sum((0xA1 <= a <= 0xA3 or 0xB0 <= a <= 0xD7) and b >= 0xA1 for a, b in pairs) >= 0.8 * len(pairs)


@lru_cache(maxsize=50_000)
def legacy_misread(run: str) -> tuple[str, str, str] | None:
    """(wrong, true, text) of a run of Latin-1 letters that is really text in a legacy codec. Four characters at least."""
    if len(run) < 4:
        return None
    raw = to_bytes(run, "cp1252")
    if raw is None:
        return None
    for wrong, true in LEGACY_PAIRS:
        try:
            text = raw.decode(true)
        except UnicodeDecodeError:
            continue
        kinds = {"gb18030": {"han"}, "big5": {"han"}, "euc_jp": {"han", "kana"}, "euc_kr": {"hangul"}, "cp1256": {"arabic"}, "cp874": {"thai"}}.get(true, {"cyrillic"})
        if not all(map(plausible, text)) or not _words_of(text, kinds, 0.9):
            continue
        if true == "gb18030" and not _common_gb(raw):
            continue
        if true == "cp1251" and sum(c.isupper() for c in text[1:]) > len(text) // 2 or true == "koi8-r" and sum(c.isupper() for c in text[1:]) > len(text) // 3:
            continue
        return wrong, true, text
    return None


def latin_in_cyrillic(run: str, before: str, after: str) -> str | None:
    """The Latin letter that two characters stand for which Russian could write too, if they stand in a Latin word: ``SeГ±ora``."""
    if len(run) != 2 or run[0] not in "ГД" or not (before + after).isascii() or not (before.isalpha() or after.isalpha()):
        return None
    raw = to_bytes(run, "cp1251")
    try:
        back = raw.decode("utf-8") if raw else ""
    except UnicodeDecodeError:
        return None
    return back if len(back) == 1 and back.isalpha() and script(back) == "latin" else None


#: The first byte of a Latin letter in UTF-8, as codecs show it that no language in use writes inside a word.
LONE_LEADS = {"Ă": "cp1250", "√": "mac_roman", "├": "cp437"}

#: A stretch of what a single-byte Western codec makes of bytes, inside a run that goes on in another script.
_WESTERN = re.compile("[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{8,}")


def legacy_inside(run: str) -> list[tuple[str, str, str, str]]:
    """(wrong, true, stretch, text) of the stretches of a run that are text in a legacy codec, the run itself not being one."""
    return [(*hit[:2], m.group(), hit[2]) for m in _WESTERN.finditer(run) if len(m.group()) < len(run) and (hit := legacy_misread(m.group())) is not None]


def shift_jis_misread(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text as written) of stretches of Shift-JIS read as cp1252; their second bytes may be ASCII."""
    found = []
    for line in re.finditer(r"[^\n　-鿿＀-￯]+", text):
        part = line.group()
        if "‚" not in part and "ƒ" not in part and not re.search(r"[\x81-\x9f]", part):
            continue
        raw = to_bytes(part, "cp1252")
        if raw is None:
            continue
        try:
            back = raw.decode("cp932")
        except UnicodeDecodeError:
            back = raw.decode("cp932", "replace")
            if back.count("�") > len(back) // 10:
                continue
        high = sum(c > "\x7f" for c in back)
        if high >= 4 and sum(script(c) in ("kana", "han") or 0x3000 <= ord(c) <= 0x303F for c in back) >= 0.8 * high and any(script(c) == "kana" and not 0xFF61 <= ord(c) <= 0xFF9F for c in back):
            found.append((line.start(), line.end(), back))
    return found


def swapped_case(text: str) -> tuple[str, str, str] | None:
    """(wrong, true, text) if Cyrillic words have their case inside out, the mark of KOI8-R and its kin confused."""
    words = SWAPPED_CASE.findall(text)
    if len(words) < 1:
        return None
    for wrong, true in CYRILLIC_SWAPS:
        raw = to_bytes("".join(words), wrong)
        if raw is not None:
            try:
                back = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if all(script(c) == "cyrillic" for c in back) and sum(c.islower() for c in back) >= 0.6 * len(back):
                return wrong, true, " ".join(words)
    return None


def swap_back(text: str, wrong: str, true: str) -> str:
    """Only the parts whose words have the case inside out are read again."""

    def part(m: re.Match) -> str:
        if not SWAPPED_CASE.search(m.group()):
            return m.group()
        raw = to_bytes(m.group(), wrong)
        return m.group() if raw is None else raw.decode(true, "replace")

    return re.sub(r"[^.!?\n]+[.!?]*", part, text)


def _capital_and_mark(text: str, run: str) -> bool:
    """A capital with an accent that ends a word in capitals, and the mark after it: ``ELLÅ’S``, ``ELVÃ©``."""
    if len(run) != 2 or not run[0].isupper() or run[1] not in "’‘”“…—–®©²™":
        return False
    return all((before := text[max(0, m.start() - 2) : m.start()]).isalpha() and before.isupper() and len(before) == 2 and not text[m.end() : m.end() + 1].islower() for m in re.finditer(re.escape(run), text))


def suspects(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, run, text as written or '') for each garbled run of a text. Null and ASCII texts have none.

    kind is ``wrong>true``, prefixed by ``html:`` where the garbled characters were escaped as entities;
    a replacement character is of kind ``lost`` and can't be restored from the text itself.
    """
    if not text:
        return []
    out: list[tuple[str, str, str]] = []
    prefix = ""
    if text.isascii() and "&" not in text:
        return []
    if "&" in text and ENTITY.search(text):
        plain = html.unescape(text)
        if plain != text:
            text, prefix = plain, "html:"
    if text.isascii():
        return []
    if "�" in text:
        out.append(("lost", "�", ""))
    runs = set(RUN.findall(text))
    joined = "".join(runs)
    shift_jis = shift_jis_misread(text) if BYTES_AS_TEXT.search(joined) else []
    out += [(f"{prefix}cp1252>cp932", text[a:b], back) for a, b, back in shift_jis]
    for a, b, _ in shift_jis:
        runs -= set(RUN.findall(text[a:b]))
    for run in runs:
        if len(run) < 2:
            if run in LONE_LEADS and re.search(f"[A-Za-z]{run}[A-Za-z]", text):
                out.append((f"{prefix}{LONE_LEADS[run]}>utf-8", run, ""))  # its second byte is lost
            continue
        if (hit := utf8_misread(run)) is not None:
            out.append((f"{prefix}{hit[0]}>utf-8", run, restore(hit[1])))
        elif (old := legacy_misread(run)) is not None:
            out.append((f"{prefix}{old[0]}>{old[1]}", run, old[2]))
        elif len(run) > 8 and (inside := legacy_inside(run)):
            out += [(f"{prefix}{w}>{t}", x, back) for w, t, x, back in inside]
        elif (part := _partly(run)) is not None:
            out.append((f"{prefix}{part[0]}>utf-8", run, part[1]))
        elif run[0] in "ГД" and len(run) == 2:
            for m in re.finditer(re.escape(run), text):
                if (back := latin_in_cyrillic(run, text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])) is not None:
                    out.append((f"{prefix}cp1251>utf-8", run, back))
                    break
    if len(out) == 1 and _capital_and_mark(text, out[0][1]):
        out.clear()
    if CYRILLIC.search(joined) and (swap := swapped_case(text)) is not None:
        out.append((f"{prefix}{swap[0]}>{swap[1]}", swap[2], ""))
    return out


#: UTF-8 sequences of three bytes and of the Latin-1 letters inside a longer run, as the commonest wrong codecs show them.
_PART = {c: re.compile("(?:[{2}][{0}]|[{3}][{0}][{0}]|[{4}][{0}][{0}][{0}])+".format(*("".join(re.escape(k) for k, b in _TABLES[c].items() if lo <= b <= hi) for lo, hi in ((0x80, 0xBF), (0xC0, 0xC1), (0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4))))) for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1250")}


@lru_cache(maxsize=200_000)
def _partly(run: str) -> tuple[str, str] | None:
    """A run garbled in part, or with some of its bytes lost: the sequences in it that still make UTF-8 must be most of it."""
    if min(run) >= "Ѐ":
        return None
    for codec, pattern in _PART.items():
        hits = [h for h in (m.group() for m in pattern.finditer(run)) if (good := utf8_misread(h)) is not None and good[0] == codec]
        if hits and (sum(map(len, hits)) >= 0.5 * len(run) or any(len(h) >= 3 for h in hits)):
            return codec, pattern.sub(lambda m: (utf8_misread(m.group()) or ("", m.group()))[1], run)
    if "â€" in run:  # the first two bytes of a quotation mark or dash, its third lost
        return "cp1252", run
    return None


def _read_again(run: str, wrong: str, true: str) -> str | None:
    """A run read with another codec, if that works out and looks like text."""
    raw = to_bytes(run, wrong)
    if raw is None:
        return None
    try:
        back = raw.decode(true)
    except UnicodeDecodeError:
        return None
    return back if all(map(plausible, back)) else None


def _undo_line(line: str, shown: list[str]) -> str:
    """A line with its runs undone. shown: wrong codecs that clear runs elsewhere in the text prove.

    A line in a legacy codec is one as a whole: its short runs, which prove nothing, follow the long ones.
    """
    if line.isascii():
        return line
    runs = RUN.findall(line)
    old = {hit[:2] for r in runs if utf8_misread(r) is None and (hit := legacy_misread(r)) is not None}
    legacy = next(iter(old)) if len(old) == 1 else None

    def undo(m: re.Match) -> str:
        run = m.group()
        if (hit := utf8_misread(run)) is not None and (legacy is None or len(run) >= 4):
            return hit[1]
        if (hit := legacy_misread(run)) is not None:
            return hit[2]
        if legacy is not None and (back := _read_again(run, *legacy)) is not None:
            return back
        if len(run) > 8 and (inside := legacy_inside(run)):
            for _, _, x, back in inside:
                run = run.replace(x, back)
            return run
        if (part := _partly(run)) is not None:
            return part[1]
        if (back := latin_in_cyrillic(run, line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1])) is not None:
            return back
        for wrong in dict.fromkeys(shown):
            if len(run) >= 2 and (back := _read_again(run, wrong, "utf-8")) is not None and len(back) < len(run):
                return back
        return run

    return RUN.sub(undo, line)


def restore(text: str | None) -> str | None:
    """The text as it was written, as far as it can be known from the text alone; applied until nothing changes."""
    if not text or not suspects(text):
        return text
    for _ in range(3):
        before = text
        if "&" in text and ENTITY.search(text):
            plain = html.unescape(text)
            if any(utf8_misread(r) or _partly(r) for r in RUN.findall(plain)):
                text = plain
        spans = shift_jis_misread(text)
        for a, b, back in reversed(spans):
            text = text[:a] + back + text[b:]

        # what the clear runs of the text show also holds for its unclear ones
        shown = [hit[0] for r in set(RUN.findall(text)) if (hit := utf8_misread(r)) is not None]
        lines = [_undo_line(line, shown) for line in text.split("\n")]
        text = "\n".join(lines)
        if (swap := swapped_case(text)) is not None:
            text = swap_back(text, swap[0], swap[1])
        if text == before:
            break
    return text
