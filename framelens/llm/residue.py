"""Template residue, filler, error pages and demands for scripts in place of an article.

1. Each text is cut into lines, and these into sentences (menus are taken whole); numbers, addresses, dates and identifiers
   are masked, and what is left is hashed. Unfilled template fields are looked for in the whole text. A sentence that is longer
   than what may stand around a message and has no word of any rule can be nothing but an article's, whatever its group; it
   needs no hash.
2. Equal hashes are counted over all texts and sources, combined before the shuffle, and each group is classified once.
   - A group that recurs over WIDE sources is judged as such: a short line of an article's traits is page furniture, and a
     sentence with any word of a message (LOOSE) is one, for articles don't repeat each other's sentences over sources.
   - What recurs nowhere goes the second route: it must match a whole phrase (PHRASES) that says itself that it is filler, a
     demand for scripts or an English or numbered message, or be filler Latin or typed at random. Messages with an address or
     a wording of their own are found by it. That something is gone or missing, in other languages, is a message by
     recurrence only: a sentence of an article can say so.
3. The classes go back to the texts. A line with a message is one if its other sentences are messages or short asides. A text is
   a case if it has an unfilled field, or a message or filler and no line of an article; furniture and a headline may stand by.

Defined results: null, empty and blank texts are no case; a text is always read whole, and lines of any length are judged alike;
a text that quotes a template field or reports a message in a sentence is no case.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.rows import map_rows
from framelens.session import cut, small, spread

#: A group that recurs over so many sources is judged as recurring.
WIDE = 3
#: Page furniture is that short; a sentence beside a message in its line, an aside, may be longer.
FURNITURE_LENGTH, ASIDE = 60, 90
#: A headline is that short at most, and more of them are the broken lines or list items of an article.
HEADLINE_LENGTH, HEADLINES = 160, 2

# --- fixed values: template fields ------------------------------------------------------------------------------------
FIELD = re.compile(
    r"""\{\{|\}\}|\{%|%\}|<%=?|%>            # template languages, also if cut in half
    | \$\{\s*\w[\w.]*\s*\} | \#\{\s*\w[\w.]*\s*\} | \{[a-z]\w*\} | \{\d\}
    | %%\w+%% | %[A-Z][A-Z_]{2,}% | @@\w+@@ | \*\|\w+\|\* | \$[A-Z][A-Z_]{2,}\$
    | <<\s*\w+\s*>> | <[A-Z][A-Z_]{2,}> | \[\[\s*\w+\s*\]\] | __[A-Z][A-Z_]*[A-Z]__
    | \[(?:[A-Z]{2,}[A-Z_ \n\r]*)\] | \[[^\[\]]{1,40}\ goes\ here\] | \[object\ Object\] | \bTKTK\b
    """,
    re.X,
)
_MAYBE_FIELD = re.compile(r"[{}<>\[@%$*_]|TKTK")
QUOTE_BEFORE = set("“\"«‘„「`")

# --- fixed values: phrases of messages, by class ----------------------------------------------------------------------
PHRASES = {
    "error": r"""
        ^(http\s+status|error|fehler|erreur|ошибка|エラー)\W*\d{3}
        ^\d{3}\W+(not\ found|page\ not\ found|forbidden|bad\ gateway|service\ unavailable|gateway\ time|internal\ server|too\ many|gone|bad\ request|unauthori[sz]ed|错误)
        ^(not\ found|page\ not\ found|forbidden|bad\ gateway|service\ unavailable|gateway\ time-?out|internal\ server\ error|too\ many\ requests|gone|bad\ request|unauthori[sz]ed)\W*(\(?\d{3}\)?)?\W*$
        \b(page|story|article|item|document|content|video|address|link|url)\b.*\b(not\ found|(does\ not|doesn.t|no\ longer)\ exists?|no\ longer\ available|has\ been\ (taken\ down|removed|deleted)|has\ moved|may\ have\ (expired|moved)|is\ not\ available|not\ available\ right\ now|could\ not\ be\ (found|loaded|shown|displayed)|cannot\ be\ (found|displayed|loaded))\b
        ^(oops|sorry|we.?re\ sorry|unfortunately|apologies)\b.*\b(page|story|article|item|address|document|content|link|video)\b
        \bfailed\ to\ load\b|\bcannot\ be\ shown\b
        ^access\ denied\s*([.!:]|$)
        \b(do\ not|don.t)\ have\ permission\ to
        \b(site|server|service)\b.{0,25}\b(under|down\ for)\ maintenance\b
        \bserver\b.*\bnot\ reachable\b|\bdatabase\b.*\b(error|unavailable|not\ reachable)\b
        \bsession\ has\ expired\b
        \bconnection\b.*\b(reset|refused|closed|timed\ out|lost|failed)\b
        ^(fatal|parse|runtime)\ error\b|\buncaught\ exception\b|^stack\ trace\b|^traceback\ \(
        ^\#\d+\ \S+
        ^\s*at\ [\w.$]+\(.*\)$|^[\w.]+(exception|error)\b(:.*)?$|^file\ ".+",\ line\ \d+|^\w+\ =\ \w+\.\w+\(\)$
        ^\{\s*"\w+":
        ^type\ status\ report$
    """,
    "script": r"""
        <noscript|</noscript>
        \b(enable|allow|activate|turn\ on|need|requires?|required|without|blocked|disabled|switch\ on)\b.*\b(java\s?script|js|scripts?|scripting|cookies)\b
        \b(java\s?script|js|scripts?|scripting|cookies)\b.*\b(enable[ds]?|allow(ed)?|activate[ds]?|is\ required|are\ required|must|needs?\ to\ be|has\ to\ be|have\ to\ be|blocked|disabled|turned\ o(ff|n)|switched\ o(ff|n))\b
        \b(ad|content)\ blocker\ (found|detected)\b
        \bverify\ (that\ )?you\ are\ (a\ )?human\b|\bnot\ a\ robot\b|\bpress\ and\ hold\b
        ^checking\ your\ browser
        ^loading.{0,3}\ if\ this\ message
        \bjavascript\b.*\b(aktivieren|einschalten)\b|\baktivieren\b.*\bjavascript\b|\b(ohne|keine)\ skripte\b|\bskripte\b.*\b(blockiert|deaktiviert)\b
        \bactiver\ javascript\b|\bscripts\ sont\ (bloqués|désactivés)\b|\bjavascript\ (est|doit)\b
        \b(active|activar|habilite)\ javascript\b|\bbloquea\ los\ scripts\b
        javascript.*(чтобы|включ)|включите\ javascript|скрипты?|скриптов
        javascript.*有効|スクリプト|javascript.*(启用|訪問|访问)|启用\s*javascript|脚本
        جافا\ ?سكريبت|جافاسكربت|जावास्क्रिप्ट|จาวาสคริปต์|ጃቫስክሪፕት
    """,
    "filler": r"""
        ^lorem\ ipsum
        ^(sample|dummy|placeholder|filler|test)\ (text|copy|headline|paragraph)\b|\bdummy\ copy\b|^test(\ test)+\W*$
        ^your\ (text|title|headline)\ here|\bgoes\ here\W*$|^(body\ )?(text|copy)\ to\ (come|follow)\b|^insert\ the\b|^replace\ this\b|^subhead\b.*\blines\b
        ^faux\ texte|^texte\ de\ remplacement|^votre\ (titre|texte)\ ici|\bà\ rédiger\W*$
        ^texto\ de\ (relleno|prueba)|^titular\ de\ prueba|^pendiente\ de\ redactar|^escriba\ aquí
        \bplatzhalter\b|\bblindtext\b|^bitte\b.*\beinsetzen\W*$|^hier\ steht\ später
        заглушка|^здесь\ будет|^текст\ для\ заполнения
        ダミー|本文が入ります|テキストが入ります|仮のテキスト
        占位|待补|此处填写|示例文本
        نص\ تجريبي|نمونہ|नमूना\ पाठ|ข้อความตัวอย่าง|የናሙና\ ጽሑፍ
    """,
    "furniture": r"""
        ^©|^copyright\b|\ball\ rights\ reserved\b
        ^(photo|image|credit|background|tags|share|related)\W*$|^error\ loading\ related\b
        ^your\ browser\ does\ not\ support\ this\ (video|audio)
        ^(please\ enable\ javascript\ to\ view\ the\ comments)
    """,
}
RULES = {kind: re.compile("|".join(f"(?:{x.strip()})" for x in lines.splitlines() if x.strip()), re.I) for kind, lines in ((k, v.replace("\\ ", " ")) for k, v in PHRASES.items())}
#: Words of menus and footers; a line of such words and signs between them is furniture.
MENU = frozenset("home|search|menu|sign in|log in|subscribe|newsletters|latest|most read|politics|business|opinion|video|contact|privacy|terms of use|my account|skip to main content|back to the front page|about|help|share|more|next|previous|comments|top stories".split("|"))
_SEPARATOR = re.compile(r"\s*[|·/•›»–]\s*|\s{2,}")
#: The stems of the usual filler Latin and its ever-changing endings.
LATIN = re.compile(r"^(lorem|ipsum|dolor|sit|situs|amet|consec|tetur|adipis|elit|sed|eius|tempor|incidid|labor|magna|aliqua|enim|minim|veniam|nostrud|ullamco|nisi|commodo|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariat|except|sint|occaec|cupidat|proident|sunt|culpa|officia|deserunt|mollit|anim|est|et|ut|in|ex|ad)\w{0,5}$", re.I)
#: Letters that lie together on a keyboard.
KEYBOARD = tuple(map(frozenset, ("qwertyuiop", "asdfjkl", "hjklzm", "x")))
TERMINAL = re.compile(r"[.!?…。！？।؟።][\"”’»“)\]』」]*$")
#: A headline may end in one of these without being a sentence.
ABBREVIATED_END = re.compile(r"\b(U\.S|Inc|Co|Corp|Ltd|Jr|Sr|S\.A|a\.m|p\.m|No)\.$")
_WORD = re.compile(r"[^\W\d_]+")
_MASKS = (
    (re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+|(?:/[\w.-]+){2,}"), "@"),
    (re.compile(r"\b(?=\w*\d)[0-9a-f-]{6,}\b", re.I), "#"),
    (re.compile(r"\d+(?:[.,:/-]\d+)*"), "#"),
    (re.compile(r"\s+"), " "),
)
#: Parts of words. No sentence without one of them is a message, a demand for scripts or filler by its phrase.
TRAITS = tuple(
    "error|fehler|erreur|ошибк|エラー|错误|status|found|exist|forbidden|gateway|unavailab|timeout|time-out|time out|too many|gone|bad request|unauthori|no longer|taken down|removed|deleted|moved|expired|available|shown|"
    "displayed|loaded|failed|oops|sorry|unfortunately|apologies|denied|permission|maintenance|reachable|database|session|connection|exception|trace|traceback|file \"|at |{\"|{ \"| = |#0|#1|#2|#3|#4|#5|#6|#7|#8|#9|"
    "abrufbar|erreichbar|verfügbar|gefunden|introuvable|indisponible|en ligne|disponible|encontrad|страница|недоступ|доступ|удал|見つかりません|表示できません|ご利用|メンテナンス|不存在|不可用|无法|删除|غير|पृष्ठ|उपलब्ध|ไม่พบ|አልተገኘም|"
    "script|scripts|js|cookies|blocker|human|robot|press and hold|browser|loading|aktivieren|skript|скрипт|スクリプト|脚本|سكريبت|سكربت|स्क्रिप्ट|สคริปต์|ስክሪፕት|"
    "lorem|sample|dummy|placeholder|filler|test|your text|your title|your headline|goes here|copy to|text to|insert|replace|subhead|texte|votre|rédiger|texto|titular|pendiente|escriba|platzhalter|blindtext|einsetzen|hier steht|"
    "заглушка|здесь|текст|ダミー|本文|テキスト|占位|待补|此处|示例|نص|نمونہ|नमूना|ข้อความ|የናሙና".split("|")
)
#: Parts of words that make a sentence a message if it recurs over sources.
LOOSE = {
    "script": tuple("javascript|client-side script|active script|allow script|cookies|not a robot|are human|noscript|checking your browser|skripte|los scripts|scripts sont|скрипт|スクリプト|脚本|سكريبت|سكربت|स्क्रिप्ट|สคริปต์|ስክሪፕት".split("|")),
    "filler": tuple("lorem ipsum|placeholder|dummy|goes here|to come|to follow|your text|your headline|blindtext|platzhalter|einsetzen|steht später|relleno|titular de prueba|pendiente de|escriba aquí|faux texte|texte de remplacement|votre titre|votre texte|à rédiger|заглушка|здесь будет|для заполнения|ダミー|本文が入ります|テキストが入ります|仮のテキスト|占位|待补|此处填写|示例文本".split("|")),
    "error": tuple(
        "error|not found|forbidden|bad gateway|unavailable|no longer available|not available|no longer exist|cannot be shown|could not be|failed to load|taken down|has expired|not reachable|maintenance|try again|"
        "been told|search box|request id|reference #|nicht gefunden|nicht verfügbar|nicht erreichbar|nicht mehr|introuvable|indisponible|plus en ligne|plus disponible|hemos encontrado|no disponible|no está disponible|no encontrada|не найдена|недоступ|больше не доступ|удал|エラー|見つかりません|表示できません|ご利用いただけません|メンテナンス中|错误|不存在|不可用|无法|已被删除|غير موجودة|غير متاح|नहीं मिला|उपलब्ध नहीं|ไม่พบ|አልተገኘም".split("|")
    ),
}


def _finder(words) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _traits() -> ahocorasick.Automaton:
    return _finder(TRAITS)


def has_trait(text: str) -> bool:
    """Some part of a word of TRAITS is in the text, whatever the case."""
    return next(_traits().iter(text.lower()), None) is not None


#: What a text must have for a mask to find anything.
_MASKABLE = re.compile(r"[\d@/]|www\.|\s\s|[\t\xa0]")


def masked(line: str) -> str:
    if _MASKABLE.search(line):
        for pattern, sign in _MASKS:
            line = pattern.sub(sign, line)
    return line.strip().lower()


@lru_cache(maxsize=100_000)
def _is_latin(word: str) -> bool:
    return LATIN.match(word) is not None


def is_gibberish(line: str) -> bool:
    """Filler Latin, or letters typed at random: four of five words, five words at least."""
    words = _WORD.findall(line)
    allowed = len(words) - 0.8 * len(words)  # words that may be others; most sentences have more after a few words
    if len(words) < 5:
        return False
    others = 0
    for w in words:
        others += not _is_latin(w)
        if others > allowed:
            break
    else:
        return True
    others = 0
    for i, w in enumerate(words):
        if i and w[0].isupper():
            return False
        others += not any(row.issuperset(w) for row in KEYBOARD)
        if others > allowed:
            return False
    return True


def is_menu(line: str) -> bool:
    parts = [p.strip().lower() for p in _SEPARATOR.split(line) if p.strip()]
    return bool(parts) and all(p in MENU for p in parts)


def is_headline(line: str) -> bool:
    return len(line) <= HEADLINE_LENGTH and (not TERMINAL.search(line) or ABBREVIATED_END.search(line) is not None and not re.search(r"[.!?…]\s", line[:-1]))


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।])\s*")


def sentences(line: str) -> list[str]:
    return [x for x in _SENTENCE_END.split(line) if x.strip()]


def classify(sentence: str, n_sources: int) -> str:
    """Class of a group of equal sentences (or short lines): error, script, filler, furniture, headline, or article.

    Recurring groups need a word of a message, others a whole phrase.
    """
    if is_menu(sentence) or RULES["furniture"].search(sentence):
        return "furniture"
    quoted = any(c in sentence for c in "“”«»") and not sentence.startswith("{")
    if not quoted and has_trait(sentence):
        for kind in ("filler", "script", "error"):
            if RULES[kind].search(sentence):
                return kind
        if n_sources >= WIDE:
            low = sentence.lower()
            for kind, words in LOOSE.items():
                if any(w in low for w in words):
                    return kind
    if not quoted and is_gibberish(sentence):
        return "filler"
    if is_headline(sentence):
        return "headline"
    return "furniture" if n_sources >= WIDE and len(sentence) <= FURNITURE_LENGTH and not quoted else "article"


def pieces(line: str) -> list[str] | None:
    """What a line is judged by: itself if it is a menu, else its sentences. None: it is an article's, whatever its groups.

    That is so if a sentence that is no aside has no trait and isn't gibberish, as no group could make a message of it,
    and the line is no headline.
    """
    if is_menu(line):
        return [line]
    if len(line) <= FURNITURE_LENGTH:
        return sentences(line) or [line]
    if any(c in line for c in "“”«»") and not line.startswith("{") and not is_headline(line):
        return None  # what quotes is no message as a whole
    parts = sentences(line)
    if not is_headline(line) and any(len(x) > ASIDE and not has_trait(x) and not is_gibberish(x) for x in parts):
        return None
    return parts if len(parts) > 1 else [line]


def unfilled(text: str) -> bool:
    """A template field that isn't quoted."""
    if not _MAYBE_FIELD.search(text):
        return False
    for m in FIELD.finditer(text):
        before = text[: m.start()].rstrip(" \n")[-1:]
        if before not in QUOTE_BEFORE and not _inside_quotes(text, m.start()):
            return True
    return False


def _inside_quotes(text: str, at: int) -> bool:
    """Right after a quotation mark and the opening sign of a field (whose closing sign this is)."""
    opened = text.rfind("“", 0, at)
    return opened > text.rfind("”", 0, at) and "{{" in text[opened : opened + 4] and "\n" not in text[opened:at]


LINES = "key {kind}, source string, field boolean, n_article int, units array<struct<line:int,h:bigint,text:string,size:int,headline:boolean>>"


def lines_of(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a text that isn't blank: key, source, field (a field is unfilled), n_article (lines that can't be but an article's),
    units (line number, hash, sentence, its length, whether its line is a headline but for its words)."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("key", "source", "field", "n_article", "units")}
            for k, t, s in zip(b["key"], b["text"], b["source"]):
                if not t or t.isspace():
                    continue
                n_article, units = 0, []
                for no, line in enumerate(t.splitlines()):
                    line = line.strip()
                    if not line:
                        continue
                    parts = pieces(line)
                    if parts is None:
                        n_article += 1
                        continue
                    headline = is_headline(line)
                    for x in parts:
                        units.append({"line": no, "h": xxhash.xxh3_64_intdigest(masked(x).encode("utf-8", "surrogatepass")) - 2**63, "text": x, "size": len(x), "headline": headline})
                for c, v in zip(out, (k, s, unfilled(t), n_article, units)):
                    out[c].append(v)
            yield out

    df = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")).where("text is not null and key is not null")
    return map_rows(spread(df), run, LINES.format(kind=dict(documents.dtypes)[key]))


def messages(lines: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(h, line, n_texts, n_sources, kind) of each group of equal masked sentences, counted over all texts.

    only: hashes of the groups whose class is wanted.
    """
    flat = lines.select("key", F.lower(F.trim("source")).alias("source"), F.explode("units").alias("u")).select("key", "source", "u.h", "u.text")
    if only is not None:
        flat = flat.join(small(only), "h", "left_semi")
    # a sentence that a text repeats counts once
    once = flat.groupBy("h", "key", "source").agg(F.min("text").alias("text"))
    by_source = once.groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    groups = by_source.groupBy("h").agg(F.sum("n").alias("n_texts"), F.count("source").alias("n_sources"), F.min("text").alias("line"))

    def run(batches):
        for b in batches:
            yield {**b, "kind": [classify(x, n) for x, n in zip(b["line"], b["n_sources"])]}

    return map_rows(groups.select("h", "line", "n_texts", "n_sources"), run, "h bigint, line string, n_texts bigint, n_sources bigint, kind string")


def found(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key) of every text that is filler, a message or a demand for scripts, or an article with an unfilled field."""
    lines = cut(lines_of(documents, key, text, source), "lines")
    # texts with an article and no unfilled field are settled; only the others need the classes of their groups
    unsettled = lines.where("not field and n_article = 0").select("key", F.explode("units").alias("u")).select("key", "u.line", "u.h", "u.size", "u.headline")
    kinds = messages(lines, cut(unsettled.select("h").distinct(), "open")).select("h", "kind")
    return lines.where("field").select("key").unionByName(judged(unsettled.join(kinds, "h"))).distinct().withColumnRenamed("key", key)


def judged(units: DataFrame) -> DataFrame:
    """(key) of the texts that are messages, from (key, line, size, headline, kind) of their sentences."""
    bad = F.col("kind").isin("error", "script", "filler")
    each = units.groupBy("key", "line").agg(
        F.bool_or(bad).alias("bad"),
        F.bool_or(~bad & (F.col("size") > ASIDE)).alias("more"),
        F.bool_and(F.col("kind") == "furniture").alias("furniture"),
        F.first("headline").alias("headline"),
    )
    is_bad = F.col("bad") & ~F.col("more")
    rest = ~is_bad & ~F.col("furniture")
    by_text = each.groupBy("key").agg(F.count_if(is_bad).alias("bad"), F.count_if(rest & F.col("headline")).alias("headline"), F.count_if(rest & ~F.col("headline")).alias("article"))
    return by_text.where(f"bad > 0 and article = 0 and headline <= {HEADLINES}").select("key")


def without(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The texts that are no case, with all their columns."""
    return documents.join(found(documents, key, text, source), key, "left_anti")
