"""Problem 10: personal information in free text, found and replaced by typed placeholders.

Method: bootstrapped contextual extraction. Recognisers cut candidates out of every text: pairs of name-like words and
number-like strings with the words around them. Seed entities (a name behind a title, a number behind
its label or with a plus sign) give weight to the patterns they stand in: two words to the left, two to the
right, one on either side. Spark scores the graph of patterns and instances in turns: a pattern by the share
of its occurrences with a known instance, an instance by the share of its occurrences in a good pattern.
High-confidence patterns so discover identifiers without a label, names without a title, and other
scripts; what they teach is a lexicon of given and family names and of number shapes, which then
tags every text. Addresses are frames of a house number and capitalised words; their street kind (a last word, a
first word, an ending) is a seed or is learnt in turns from the patterns that addresses with known kinds stand in.
Mail addresses are told by their own form; mail hosts written around their at sign or dots without brackets must be hosts seen plainly elsewhere.

Scale: two passes over the texts without a shuffle of texts; the graph is aggregated before it is joined. A
pattern or word counts from a few occurrences in a corpus of any size, so a rare name is not lost in a large one; the
lexicon sent to the tasks grows with the distinct words that recur; each of its tables is counted, and one of more than
MOST_LEARNT entries is an error. Every text is read whole.

Defined results: null, empty and blank texts have no spans; spans are counted in code points and do not overlap (mail
address, address, number and name win in this order); a repeated document gives its spans once per row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilegrain.session import cut

#: Fewest occurrences of a pattern of names, of a word of a name, of a small word, of a number shape or its pattern, of a street or town, of a street kind.
PATTERN, NAME, SMALL, FIGURE, PLACE, WAY = 3, 2, 3, 2, 2, 3
ROUNDS = 3
#: Most entries of one learnt table, some 200 MB in a task.
MOST_LEARNT = 2_000_000
TYPES = ("email", "address", "id_number", "phone", "name")

# Words that mark what follows or precedes.
TITLES = frozenset("mr mrs ms miss dr prof sir frau herr sr sra srta don doña mme mlle monsieur madame signor signora श्री श्रीमती".split())
HONORIFICS = "さん 様 氏".split()
PARTICLES = frozenset("de la del du von van der den da di le".split())
LABELS = (
    r"ssn|social security(?: number| no\.?)?|my social is|passport(?: (?:number|nr|no)\.?)?|(?:driv(?:ing|er'?s)) licen[cs]e(?: no\.?| number)?|licen[cs]e (?:no\.?|number)|dl ?#|nino|ni (?:number|no\.?)|national insurance(?: number)?|"
    r"nir|n° sécu|numéro de sécurité sociale|sécurité sociale|dni|nif|nie|steuer-?id|steuernummer|idnr\.?|steuer-identifikationsnummer|personalausweis(?:nummer)?|マイナンバー|個人番号|आधार(?: संख्या| नंबर)?|aadhaar(?: number)?|पैन"
)
NOT_HOSTS = "png jpg jpeg tif tiff gif heic raw mov mp4 pdf txt json csv html xml zip".split()

_LETTER = r"[^\W\d_\p{Han}\p{Hiragana}\p{Katakana}ー]"  # of a script that parts words
WORD = rf"{_LETTER}+(?:['’]{_LETTER}+)*(?:[-‐]{_LETTER}+(?:['’]{_LETTER}+)*)*"
_TOKEN = re.compile(rf"(?P<w>{WORD})|(?P<n>\d+)|(?P<p>[^\s\w])|(?P<x>\n)|(?P<c>\w)")
_HAN = r"[\p{Han}ノヶ々]"
_HAN_NAME = re.compile(rf"({_HAN}{{1,4}})[ 　]({_HAN}{{1,4}})(?=({'|'.join(HONORIFICS)}))")

# ---------------------------------------------------------------- forms

_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=1)
def _plain() -> dict[int, str]:
    """Digits of every script and full-width signs to their ASCII forms, one character each."""
    table = {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c not in table}
    return table | {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x00A0: " ", 0x202F: " ", 0x3000: " "}


def plain_of(text: str) -> str:
    """The text with ASCII digits and signs, of the same length."""
    return text if text.isascii() else text.translate(_plain())


_LOCAL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+\-]*[A-Za-z0-9À-ɏ_+\-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
MAIL = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_@.+])({_LOCAL})@({_LABEL}(?:\.{_LABEL})+)(?![A-Za-zÀ-ɏ0-9_@])")
AROUND = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9_@.+])({_LOCAL})(?: ?@ ?| ?[\[({{] ?at ?[\])}}] ?| at )({_LABEL}(?:(?:\.| ?[\[({{] ?dot ?[\])}}] ?| dot ){_LABEL})+)(?![A-Za-zÀ-ɏ0-9_@])", re.I)
#: The sign or word between name and host with the first dot of the host: only around these AROUND is tried.
_SEPARATED = re.compile(rf"(?: ?@ ?| ?[\[({{] ?at ?[\])}}] ?| at ){_LABEL}(?:\.| ?[\[({{] ?dot ?[\])}}] ?| dot ){_LABEL}", re.I)


def _written_around(plain: str) -> Iterator[re.Match]:
    """All matches of AROUND. A name holds no blank, so it begins after the last one before the sign."""
    end = 0
    for m in _SEPARATED.finditer(plain):
        start = max(end, max(plain.rfind(c, 0, m.start()) for c in " \t\n\r") + 1)
        if m.start() >= end and (found := AROUND.search(plain, start, m.start() + 1000)) and found.start() <= m.start():
            end = found.end()
            yield found


_DOT = re.compile(r" ?[\[({] ?dot ?[\])}] ?| dot ", re.I)

#: Number-like candidates. Their shape, not their form here, decides what they are.
NUMBER = re.compile(
    r"(?<![A-Za-zÀ-ɏ\d_.,+/\-])(?:"
    r"(?P<phone>\+\d{1,3}[ .\-]?(?:\(0\)[ ]?)?\d{1,4}(?:[ .\-/]?\d{2,8}){1,5}|\(\d{2,5}\)[ ]?\d{3,4}[ .\-]?\d{3,4}|\d{3}\(\d{3,4}\)\d{4}|0\d{2,4}/\d{4,6}(?:-\d{2,4})?|00\d{2}(?! \d{4} \d{4}(?!\d))(?: \(?\d{1,6}\)?){2,4}|1-\d{3}-\d{3}-\d{4}|\d{3}([ .\-])\d{3}\2\d{4}|0\d{4}[ \-]\d{6}|0\d{4}-\d{3}-\d{3}|0\d{2}[ \-]\d{4}[ \-]\d{4}|0\d(?:([ .])\d{2})(?:\3\d{2}){3}|0\d{2} \d{5} \d{3})"
    r"|(?P<id>\d{3}([ \-])\d{2}\5\d{4}|\d{9}(?!\d)|[A-Z]{1,2}[ ]?\d{3}[ ]?\d{4,5}|[A-Za-z]{1,2}\d{6,9}[A-Za-z]?|[A-Za-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Za-z]|[A-Za-z]{2}-\d{6}-[A-Za-z]|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{15}|\d{2}\.\d{3}\.\d{3}-?[A-Za-z]|\d{8}-?[A-Za-z]|[A-Za-z]-?\d{7}-?[A-Za-z]|\d{2} \d{3} \d{3} \d{3}|\d{11,12}|\d{4}([ \-])\d{4}\6\d{4})"
    r")(?![A-Za-zÀ-ɏ\d_+]|[/\-.]\d)"
)
#: Four digits with at most two signs between any two: a candidate has at least so many, so only these places are tried.
_FIGURES = re.compile(r"\d(?:[ .\-/()]{0,2}\d){3,}")


def _numberlike(plain: str) -> Iterator[re.Match]:
    """All matches of NUMBER, sought only around figures."""
    end = 0
    for m in _FIGURES.finditer(plain):
        if m.end() > end:
            for n in NUMBER.finditer(plain, max(end, m.start() - 5), m.end() + 8):
                if n.start() < m.end():  # else it belongs to the next figures and may be cut off here
                    end = n.end()
                    yield n


_LABEL_AT_END = re.compile(rf"(?:^|(?<=[^\p{{L}}\d]))(?:{LABELS})(?:[ ]?(?:[:#=]|は))?[ ]*(?:\p{{L}}{{2,4}} )?$", re.I)

_CAP = r"\p{Lu}[\p{L}\p{M}'’]+"
_TOWN = rf"{_CAP}(?!\d)(?:[ \-]{_CAP}(?!\d)){{0,2}}"
_POST = r"(?:\d{5}(?!\d)|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}(?![A-Za-z]))"
_UNIT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room) \d{1,4}[A-Za-z]?)"
_FLOOR = r"(?:,? (?:\d{1,2}(?:st|nd|rd|th) [Ff]loor|[Ff]loor \d{1,2}|#\d{1,4}[A-Za-z]?|" + _UNIT[3:] + ")"
_WAY = r"(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave|Drive|Close|Crescent|Row|Terrace|Court|Place|Way|Square|Boulevard|Blvd|Grove|Hill|Mews|Walk|Gardens|Parade|Alley)"
_TAIL = rf"(?:,? {_POST}|, {_TOWN}(?:,? {_POST})?)?"
_TAIL_ROMANCE = rf"(?:, \d{{5}} {_TOWN})?"
_COMPASS = r"(?: (?:[NS][EW]?|[EW])(?![\p{L}\d]))"
ADDRESS = re.compile(
    r"(?<![A-Za-zÀ-ɏ\d/\-])(?:"
    rf"(?:{_UNIT}, )?\d{{1,4}}[a-z]? (?:St\. )?(?:{_CAP} ){{1,3}}{_WAY}(?![\p{{L}}]){_COMPASS}?{_FLOOR}?{_TAIL}"
    rf"|P\.? ?O\.? ?Box \d{{1,5}}{_TAIL}"
    rf"|(?:(?:Alte|Neue|Große|Kleine|Obere|Untere) )?{_CAP}?(?:straße|strasse|gasse|weg|platz|allee|str\.|ufer|ring) \d{{1,4}}(?: ?[a-z](?![\p{{L}}]))?(?:, \d{{5}} {_TOWN})?"
    rf"|(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Hinter der|Unter den) {_CAP} \d{{1,4}}(?: ?[a-z](?![\p{{L}}]))?(?:, \d{{5}} {_TOWN})?"
    rf"|\d{{1,4}}[a-z]?(?: (?:bis|ter))?,? (?:rue|avenue|av\.|chemin|impasse|place|quai|boulevard|bd|allée|route|cours) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?{_CAP}(?:[ \-](?:{_CAP}|de|la|des|du)){{0,3}}{_TAIL_ROMANCE}"
    rf"|(?:Calle|C/|Avda\.|Avenida|Paseo|Plaza|Camino|Ronda) ?(?:(?:del|de la|de los|de las|de) )?{_CAP}(?: (?:{_CAP}|del|de|la)){{0,3}},?(?: n[º°]\.?)? \d{{1,4}}[a-z]?(?:, \d{{1,2}}[º°](?: [A-Z](?![\p{{L}}]))?)?{_TAIL_ROMANCE}"
    rf"|(?:{_HAN}{{1,5}}[県府都道])[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}々]{{2,16}}?\d{{1,3}}(?:-\d{{1,3}}){{1,2}}"
    r"|(?:मकान नं\.?|फ्लैट(?: नं\.?)?|घर नं\.?) \d{1,4}[a-z]?, [\p{Devanagari} ]{2,40}?(?:रोड|गली|मार्ग|पथ|सड़क|नगर|चौक)(?:, \p{Devanagari}+(?:[ ,-]*\d{6})?)?"
    r")"
)

#: An English address in any case; its street must have been met in plain case, and its town for the tail to count.
LOOSE = re.compile(
    rf"(?<![\p{{L}}\d/\-])(?:(?:{_UNIT}, )?\d{{1,4}}[a-z]? (?P<street>(?:st\. )?(?:[\p{{L}}'’]+ ){{1,3}}{_WAY})(?![\p{{L}}]){_FLOOR}?|p\.? ?o\.? ?box \d{{1,5}})(?P<tail>(?:,? {_POST}|, (?P<town>[\p{{L}}]++(?!\d)(?:[ \-][\p{{L}}]++(?!\d))?)(?:,? {_POST})?)?)",
    re.I,
)
STREET = re.compile(rf"\d{{1,4}}[a-z]? (?P<street>(?:St\. )?(?:{_CAP} ){{1,3}}{_WAY})(?![\p{{L}}]){_FLOOR}?(?:, (?P<town>{_TOWN}))?")

_OF = r"(?:de la|de los|de las|del|della|dei|do|da|dos|das|des|du|de|van de|van der|van)"
_PLACED = r"(?![\p{L}\d]|[.:/\-]\d|[%°€$])"
#: Frames of a house number and the words beside it: the street kind as last word, as first word, as an ending.
FRAMES = {
    "last": re.compile(rf"(?<![\p{{L}}\d/\-.,#])\d{{1,4}}[a-z]? (?:St\. )?(?:{_CAP} ){{1,3}}(?P<k>\p{{Lu}}\p{{L}}{{1,3}}\.|{_CAP})(?![\p{{L}}\d])"),
    "first": re.compile(rf"(?<![\p{{L}}\d])(?P<k>\p{{L}}{{2,5}}\.|\p{{Lu}}\p{{L}}{{1,9}})(?: {_OF})? (?:{_CAP} (?:{_OF} )?){{0,3}}{_CAP},? \d{{1,4}}[a-z]?{_PLACED}"),
    "ending": re.compile(rf"(?<![\p{{L}}\d]|\p{{L}}\. |\p{{Lu}}\p{{L}}{{1,9}} )(?P<k>\p{{Lu}}\p{{Ll}}{{6,}}) \d{{1,4}}[a-z]?{_PLACED}"),
}
#: Street kinds that seed the learning.
SEED_KINDS = {
    "last": frozenset("street st. road rd. lane ln. avenue ave drive close crescent row terrace court place way square boulevard blvd grove hill mews walk gardens parade alley".split()),
    "first": frozenset("calle avda. avenida paseo plaza camino ronda".split()),
    "ending": frozenset("straße strasse gasse weg platz allee ufer ring".split()),
}


def frames(text: str, seeds: dict[str, frozenset] = SEED_KINDS) -> Iterator[tuple[str, tuple[str, str, str], bool]]:
    """(kind, patterns, seed) of every frame: the kind is last, first or ending and the word; an ending is given at several lengths."""
    for role, form in FRAMES.items():
        for m in form.finditer(text):
            i, j = m.span()
            word = m["k"].casefold()
            if word.rstrip(".") in seeds[role]:
                word = word.rstrip(".")
            before = tokens_of(text[max(0, i - 40) : i].rsplit("\n", 1)[-1])[-2:]
            after = tokens_of(text[j : j + 30].split("\n", 1)[0])[:2]
            around = (*_around([*before, (0, 0, "_", "n"), *after], len(before), len(before))[:2], "")  # one word on either side says too little
            if role == "ending":
                seed = word.endswith(tuple(seeds[role]))
                for n in (4, 5, 6):
                    yield f"{role} {word[-n:]}", around, seed
            else:
                yield f"{role} {word}", around, word in seeds[role]


def learnt_address(kinds: dict[str, float]) -> re.Pattern | None:
    """The form of addresses of learnt kinds; null where there are none."""
    held = {role: sorted((k.split(" ", 1)[1] for k in kinds if k.startswith(role + " ")), key=lambda w: (-len(w), w)) for role in FRAMES}
    tail = rf"(?:,? (?:\d{{4,5}}(?: [A-Z]{{2}}(?![\p{{L}}]))? {_TOWN}|{_POST})|, {_TOWN}(?:,? {_POST})?)?"
    words = lambda role: "(?i:" + "|".join(re.escape(w) for w in held[role]) + ")"
    forms = []
    if held["last"]:
        forms.append(rf"(?:{_UNIT}, )?\d{{1,4}}[a-z]? (?:St\. )?(?:{_CAP} ){{1,3}}(?=\p{{Lu}}){words('last')}(?![\p{{L}}]){_COMPASS}?{_FLOOR}?{tail}")
    if held["first"]:
        forms.append(rf"{words('first')}(?: {_OF})? (?:{_CAP} (?:{_OF} )?){{0,3}}{_CAP},?(?: n[º°]\.?)? \d{{1,4}}[a-z]?{_PLACED}{tail}")
    if held["ending"]:
        forms.append(rf"\p{{Lu}}\p{{Ll}}*{words('ending')} \d{{1,4}}[a-z]?{_PLACED}{tail}")
    return re.compile(r"(?<![\p{L}\d/\-])(?:" + "|".join(forms) + ")") if forms else None


# ---------------------------------------------------------------- candidates


def _fold(word: str) -> str:
    word = word.casefold()
    return "9" * len(word) if word.isdecimal() else word.replace("’", "'") if "’" in word else word


def _around(tokens: list[tuple[int, int, str, str]], i: int, j: int) -> tuple[str, str, str]:
    """Patterns of the tokens i to j: two words left, two right, one on either side."""
    at = lambda k: "^" if k < 0 or tokens[k][3] == "x" else _fold(tokens[k][2])
    to = lambda k: "$" if k >= len(tokens) or tokens[k][3] == "x" else _fold(tokens[k][2])
    l1, r1 = at(i - 1), to(j + 1)
    l2 = "^" if l1 == "^" else at(i - 2)
    r2 = "$" if r1 == "$" else to(j + 2)
    return f"L {l2} {l1}", f"R {r1} {r2}", f"B {l1} _ {r1}"


def tokens_of(text: str) -> list[tuple[int, int, str, str]]:
    return [(m.start(), m.end(), m.group(), m.lastgroup) for m in _TOKEN.finditer(text)]


def _namelike(word: str) -> bool:
    return len(word) > 1 and (word[0].isupper() or "ऀ" <= word[0] <= "ॿ" or "ऀ" <= word[0] <= "෿") and word.casefold() not in TITLES and word.casefold() not in PARTICLES


def _bare(word: str) -> str:
    return word[:-2] if word[-2:] in ("'s", "’s") and len(word) > 3 else word


def name_pairs(text: str) -> Iterator[tuple[list[str], list[str], tuple[str, str, str], bool]]:
    """(given parts, family parts, patterns, seed) of every pair of name-like words."""
    tokens = tokens_of(text)
    for i, (_, end, word, kind) in enumerate(tokens):
        if kind != "w" or not _namelike(word):
            continue
        j = i + 1
        if j + 1 < len(tokens) and tokens[j][3] == "w" and len(tokens[j][2]) == 1 and tokens[j][2].isupper() and tokens[j + 1][2] == ".":
            end, j = tokens[j + 1][1], j + 2
        steps, prefix = 0, ""
        while j < len(tokens) and steps < 3 and tokens[j][2] in PARTICLES:
            prefix += tokens[j][2] + " "
            end, j, steps = tokens[j][1], j + 1, steps + 1
        if j >= len(tokens) or tokens[j][3] != "w" or tokens[j][0] - end > 1 + steps or not _namelike(tokens[j][2]) or "\n" in text[tokens[i][1] : tokens[j][0]]:
            continue
        other = _bare(tokens[j][2])
        given, family = (other, word) if not prefix and word.isupper() and not other.isupper() and word.lower() != word else (word, other)
        if prefix:
            family = prefix + family
        seed = i > 0 and (tokens[i - 1][2].casefold() in TITLES or tokens[i - 1][2] == "." and i > 1 and tokens[i - 2][2].casefold() in TITLES)
        yield _fold(given).split("-"), _fold(family).split("-"), _around(tokens, i, j), seed
    for m in _HAN_NAME.finditer(text):
        yield [m.group(2)], [m.group(1)], ("L は", f"R {m.group(3)}", f"B は _ {m.group(3)}"), True


def _shape(value: str, kind: str) -> str:
    """p or i for the recogniser, then the form; of a phone number the leading sign or digits stay."""
    lead = "" if kind == "id" else value[:2] if value[:1] == "0" else value[:1] if value[:1] in "+1(" else ""
    return kind[0] + " " + lead + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", value[len(lead) :]))


def numbers(text: str) -> Iterator[tuple[int, int, str, tuple[str, str, str], str]]:
    """(start, end, shape, patterns, seed type or empty) of number-like strings; text has plain digits."""
    for m in _numberlike(text):
        i, j = m.span()
        left = text[max(0, i - 40) : i]
        before = tokens_of(left.rsplit("\n", 1)[-1])[-2:]
        after = tokens_of(text[j : j + 30].split("\n", 1)[0])[:2]
        whole = [*before, (0, 0, "_", "n"), *after]
        label = bool(_LABEL_AT_END.search(left))
        seed = ("id_number" if label else "") if m["id"] else "phone" if m.group()[0] == "+" else ""
        yield i, j, _shape(m.group(), "phone" if m["phone"] else "id"), _around(whole, len(before), len(before)), seed


# ---------------------------------------------------------------- learning


_SMALL = re.compile(r"(?<![\w'’-])\p{Ll}{2,20}(?![\w'’-])")


def _street(written: str) -> str:
    """A street without its kind, in lower case."""
    return written.casefold().replace("’", "'").rsplit(" ", 1)[0]


_PAIRS = "kind string, a string, b string, l string, r string, c string, seed string"


def candidates(texts: DataFrame, text: str, kinds: dict[str, frozenset] = SEED_KINDS) -> DataFrame:
    """Aggregated candidates: kind, words or shape, patterns, seed, how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                for given, family, (left, right, both), seed in name_pairs(t):
                    for a in given:
                        for b in family:
                            k = ("name", a, b, left, right, both, "name" if seed else "")
                            seen[k] = seen.get(k, 0) + 1
                plain = plain_of(t)
                for _, _, shape, (left, right, both), seed in numbers(plain):
                    k = ("number", shape, "", left, right, both, seed)
                    seen[k] = seen.get(k, 0) + 1
                for m in MAIL.finditer(plain):
                    if m.group(2).rsplit(".", 1)[-1].casefold() not in NOT_HOSTS:
                        k = ("host", m.group(2).casefold(), "", "", "", "", "")
                        seen[k] = seen.get(k, 0) + 1
                for way, (left, right, both), seed in frames(plain, kinds) if _DIGIT.search(plain) else ():
                    k = ("way", way, "", left, right, both, "way" if seed else "")
                    seen[k] = seen.get(k, 0) + 1
                for m in STREET.finditer(plain):
                    for k in ("street", _street(m["street"]), "", "", "", "", ""), ("town", (m["town"] or "").casefold(), "", "", "", "", ""):
                        if k[1]:
                            seen[k] = seen.get(k, 0) + 1
                for w in _SMALL.findall(t):
                    k = ("small", w, "", "", "", "", "")
                    seen[k] = seen.get(k, 0) + 1
            columns = [*zip(*seen, strict=True)] if seen else [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(seen.values()), pa.int64())], ["kind", "a", "b", "l", "r", "c", "seed", "n"])

    found = texts.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL").mapInArrow(run, _PAIRS + ", n long")
    return found.groupBy("kind", "a", "b", "l", "r", "c", "seed").agg(F.sum("n").alias("n"))


_UNCASED = r"^[\x{900}-\x{DFF}]+$"
#: Patterns that only say where a sentence or line ends.
_VAGUE = r"^(R [.!?;…。।|$]( |$)|L . \^$|L \^ \^$|B [.^!?;,] _ [.$!?;,])"
_BARE = r"^(L \^ \^|R \$ \$)$"


def _patterns(scored: DataFrame, floor: int, least: float, vague: str = "^$") -> DataFrame:
    """(p, score) of patterns by the share of their occurrences with a known instance (column w)."""
    each = scored.select(F.explode(F.array("l", "r", "c")).alias("p"), "n", "w").where(~F.col("p").rlike(vague))
    rated = each.groupBy("p").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("score"), F.sum("n").alias("m"))
    return rated.where((F.col("m") >= floor) & (F.col("score") >= least)).select("p", "score")


def _best(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """rows with best: the score of the best of their three patterns."""
    for i, c in enumerate(("l", "r", "c")):
        rows = rows.join(rated.select(F.col("p").alias(c), F.col("score").alias(f"_s{i}")), c, "left")
    return rows.withColumn("best", F.greatest(*[F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(3)])).drop("_s0", "_s1", "_s2")


def _fetched(rows: DataFrame) -> list:
    """What is learnt, for the broadcast to the tasks: more than MOST_LEARNT rows are an error, never cut."""
    held = rows.limit(MOST_LEARNT + 1).collect()
    if len(held) > MOST_LEARNT:
        raise ValueError(f"a lexicon of more than {MOST_LEARNT} entries; raise the fewest occurrences")
    return held


def ways(met: DataFrame) -> dict[str, float]:
    """Street kinds learnt from the patterns of known ones: a pattern counts by the share of its frames with a known kind, a kind by the share of its frames in a good pattern.

    Of endings of one word that score alike the longest is kept.
    """
    met = cut(met)
    known = met.where("seed = 'way'").select("a").limit(0).withColumn("score", F.lit(1.0))
    for _ in range(2):
        scored = met.join(known, "a", "left").withColumn("w", F.when(F.col("seed") == "way", 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).drop("score")
        rated = cut(_patterns(scored, PATTERN, 0.5, _VAGUE + "|^$"))
        told = _best(met.where("seed = ''"), rated)
        every = told.groupBy("a").agg((F.sum(F.col("n") * F.col("best")) / F.sum("n")).alias("score"), F.sum("n").alias("m"), F.count_distinct(F.when(F.col("best") > 0, F.struct("l", "r"))).alias("places"))
        known = cut(every.where((F.col("m") >= WAY) & (F.col("score") >= 0.5)).select("a", "score"))
    found = {r["a"]: r["score"] for r in _fetched(known)}
    return {k: v for k, v in found.items() if not (k.startswith("ending ") and any(o != k and o.endswith(k.split(" ", 1)[1]) and o.startswith("ending ") for o in found))}


def learn(texts: DataFrame, text: str, kinds: dict[str, frozenset] = SEED_KINDS) -> dict[str, dict[str, float]]:
    """given, family: words; shape: number shapes by type; pattern: good patterns by type; host: mail hosts; way: street kinds beyond the seeds."""
    held = cut(candidates(texts, text, kinds))
    out: dict[str, dict[str, float]] = {}

    names = held.where("kind = 'name'")
    seeds = names.where("seed = 'name'")
    words = seeds.select(F.explode(F.array(F.concat(F.lit("g "), "a"), F.concat(F.lit("f "), "b"))).alias("w")).groupBy("w").agg(F.count("*").alias("k")).select("w", F.lit(1.0).alias("score"))
    for _ in range(ROUNDS):
        words = cut(words)
        known = names.join(words.select(F.col("w").alias("_g"), F.col("score").alias("sa")), F.concat(F.lit("g "), "a") == F.col("_g"), "left")
        known = known.join(words.select(F.col("w").alias("_f"), F.col("score").alias("sb")), F.concat(F.lit("f "), "b") == F.col("_f"), "left")
        sides = F.col("sa").isNotNull().cast("int") + F.col("sb").isNotNull().cast("int")
        scored = known.withColumn("w", sides / 2.0)
        rated = cut(_patterns(scored.where("seed = ''"), PATTERN, 0.4, _BARE))
        told = _best(names, rated).withColumn("best", F.when(F.col("seed") == "name", 1.0).otherwise(F.when(F.col("best") >= 0.5, F.col("best")).otherwise(0.0)))
        each = told.select(F.explode(F.array(F.concat(F.lit("g "), "a"), F.concat(F.lit("f "), "b"))).alias("w"), "n", "best")
        every = each.groupBy("w").agg((F.sum(F.col("n") * F.col("best")) / F.sum("n")).alias("score"), F.sum("n").alias("m")).where(F.col("m") >= NAME)
        words = every.where("score >= 0.4").select("w", "score")
    every = cut(every)
    taught = every.where("score >= 0.4").select("w")
    # Scripts without capitals: a pair between the words that enclose known names is a name.
    firm = _patterns(scored, PATTERN, 0.05).where(F.col("p").rlike(r"^B [^.^$!?,|]+ _ [^.^$!?,|]+$"))
    uncased = _best(names.where(F.col("a").rlike(_UNCASED) & F.col("b").rlike(_UNCASED)), firm)
    for role, c in (("g ", "a"), ("f ", "b")):
        taught = taught.union(uncased.groupBy(c).agg((F.sum(F.when(F.col("best") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("s"), F.sum("n").alias("m")).where((F.col("m") >= NAME) & (F.col("s") >= 0.3)).select(F.concat(F.lit(role), c).alias("w")))
    seeded = seeds.where(F.col("a").rlike(r"^\p{IsHan}")).select(F.explode(F.array(F.concat(F.lit("g "), "a"), F.concat(F.lit("f "), "b"))).alias("w"))
    rows = [(r["w"], 1.0) for r in _fetched(taught.union(seeded).distinct())]
    out["given"] = {w[2:]: s for w, s in rows if w[0] == "g"}
    out["family"] = {w[2:]: s for w, s in rows if w[0] == "f"}
    small = held.where("kind = 'small'")
    either = every.groupBy(F.expr("substring(w, 3)").alias("a")).agg(F.max("score").alias("score"), F.sum("m").alias("m"))
    unlike = either.where((F.col("score") < 0.2) & (F.col("m") >= SMALL)).select("a")
    capital = every.groupBy(F.expr("substring(w, 3)").alias("a")).agg(F.sum("m").alias("m"))
    lower = small.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= SMALL).join(capital, "a", "left").where("n > coalesce(m, 0)").select("a")
    common = unlike.union(lower)
    out["common"] = {r["a"]: 0.0 for r in _fetched(common.distinct())}
    out["name"] = {r["p"]: r["score"] for r in _fetched(rated.where("score >= 0.8"))}

    figures = held.where("kind = 'number'")
    for kind in ("phone", "id_number"):
        mine = F.col("seed") == kind
        same = figures.where(F.col("a").startswith(kind[0] + " "))
        shapes = cut(same.groupBy("a").agg((F.sum(F.when(mine, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"), F.sum("n").alias("m")).where("score > 0").select("a", "score"))
        for _ in range(ROUNDS):
            # Phone numbers have few look-alikes, so every shape counts by its score; id numbers share shapes with rolls and orders, so only a nearly pure shape counts.
            pure = 0.0 if kind == "phone" else 0.6
            scored = same.join(shapes, "a", "left").withColumn("w", F.when(mine, 1.0).otherwise(F.when(F.col("score") >= pure, F.col("score")).otherwise(0.0)))
            rated = cut(_patterns(scored, FIGURE, 0.3, _VAGUE))
            told = _best(same, rated).withColumn("best", F.when(mine, 1.0).otherwise(F.when(F.col("best") >= 0.4, 1.0).otherwise(F.col("best"))))
            shapes = cut(told.groupBy("a").agg((F.sum(F.col("n") * F.col("best")) / F.sum("n")).alias("score"), F.sum("n").alias("m")).where((F.col("m") >= FIGURE) & (F.col("score") >= 0.01)).select("a", "score"))
        out["shape " + kind] = {r["a"]: r["score"] for r in _fetched(shapes)}
        out["pattern " + kind] = {r["p"]: r["score"] for r in _fetched(rated.where("score >= 0.4"))}
    out["way"] = ways(held.where("kind = 'way'"))
    hosts = held.where("kind = 'host'").select("a").distinct()
    out["host"] = {r["a"]: 1.0 for r in _fetched(hosts)}
    for kind in ("street", "town"):
        met = held.where(F.col("kind") == kind)
        out[kind] = {r["a"]: 1.0 for r in _fetched(met.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= PLACE).select("a"))}
    return out


# ---------------------------------------------------------------- tagging


class Tagger:
    def __init__(self, learnt: dict[str, dict[str, float]]) -> None:
        self.given, self.family, self.learnt = learnt["given"], learnt["family"], learnt
        self.ways = learnt_address(learnt["way"])
        self._numbers: tuple[str | None, list] = None, []
        self._held: dict[str, tuple[bool, bool]] = {}
        han = [(w, k) for k in ("given", "family") for w in learnt[k] if re.fullmatch(rf"{_HAN}+", w)]
        groups = ["|".join(sorted((re.escape(w) for w, k in han if k == kind), key=lambda w: (-len(w), w))) for kind in ("family", "given")]
        enclosed = rf"(?<=は)(?:{_HAN}{{1,5}}(?:{groups[1]})|(?:{groups[0]}){_HAN}{{1,4}})(?=(?:{'|'.join(HONORIFICS)}))"
        self.han = re.compile(rf"{enclosed}|(?:{groups[0]})[ 　]?(?:{groups[1]})") if all(groups) else None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        plain = plain_of(text)
        found: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(i: int, j: int, kind: str) -> None:
            if i < j and not any(a < j and i < b for a, b in taken):
                found.append((i, j, kind))
                taken.append((i, j))

        for kind in TYPES:
            for i, j in getattr(self, kind)(text, plain):
                add(i, j, kind)
        return sorted(found)

    def email(self, text: str, plain: str) -> Iterator[tuple[int, int]]:
        ends = -1
        for m in MAIL.finditer(plain):
            if m.group(2).rsplit(".", 1)[-1].casefold() not in NOT_HOSTS:
                ends = m.end()
                yield m.span()
        for m in _written_around(plain):
            host = _DOT.sub(".", m.group(2)).casefold()
            bracketed, last = any(c in plain[m.end(1) : m.start(2)] for c in "[({"), host.rpartition(".")[2]
            if bracketed and last.isalpha() and last not in NOT_HOSTS and not any(host.endswith(h) or h in host for h in self.learnt["host"]):
                yield m.span()  # brackets leave no doubt
                continue
            while host and host not in self.learnt["host"]:
                host = host.rpartition(".")[0]
            if host and m.end() != ends:
                end = m.start(2)
                parts = host.count(".") + 1
                for k, label in enumerate(re.finditer(rf"{_LABEL}(?=\.| ?[\[({{]| dot |$)", m.group(2), flags=re.I)):
                    if k == parts - 1:
                        end = m.start(2) + label.end()
                yield m.start(), end if end > m.start(2) else m.end()

    def address(self, text: str, plain: str) -> Iterator[tuple[int, int]]:
        if not _DIGIT.search(plain):
            return
        for m in ADDRESS.finditer(plain):
            yield m.span()
        for m in self.ways.finditer(plain) if self.ways else ():
            yield m.span()
        for m in LOOSE.finditer(plain):
            if not m["street"] or _street(m["street"]) in self.learnt["street"]:
                known = not m["town"] or m["town"].casefold() in self.learnt["town"]
                if not known and (short := m["town"].casefold().split()[0]) in self.learnt["town"]:
                    yield m.start(), m.start("town") + len(short)
                else:
                    yield m.start(), m.end() if known else m.start("tail")

    def _number(self, plain: str, kind: str) -> Iterator[tuple[int, int]]:
        shapes, patterns = self.learnt["shape " + kind], self.learnt["pattern " + kind]
        sure = 0.3 if kind == "phone" else 0.6  # phone shapes have few look-alikes
        if self._numbers[0] is not plain:
            self._numbers = plain, list(numbers(plain))
        for i, j, shape, around, seed in self._numbers[1]:
            if shape[0] == kind[0] and (seed == kind or shapes.get(shape, 0.0) >= sure or shape in shapes and max(patterns.get(p, 0.0) for p in around) >= 0.4):
                yield i, j

    def id_number(self, text: str, plain: str) -> Iterator[tuple[int, int]]:
        return self._number(plain, "id_number")

    def phone(self, text: str, plain: str) -> Iterator[tuple[int, int]]:
        return self._number(plain, "phone")

    def _told(self, word: str) -> tuple[bool, bool]:
        """Whether a word is a given name, and whether it was never met as anything but a part of a name; words of the last texts are kept."""
        held = self._held.get(word)
        if held is None:
            if len(self._held) > 200_000:
                self._held.clear()
            low, common = word.casefold(), self.learnt["common"]
            new = len(word) > 2 and (word[0].isupper() or word.islower()) and low not in TITLES and low not in PARTICLES and not any(p in common or p in self.family for p in _fold(word).split("-"))
            held = self._held[word] = len(word) > 1 and self._is(_bare(word), self.given), new
        return held

    def _is(self, word: str, held: dict[str, float]) -> bool:
        low = _fold(word)
        return low in held or ("-" in low or "‐" in low) and all(p in held for p in low.replace("‐", "-").split("-"))

    def name(self, text: str, plain: str) -> Iterator[tuple[int, int]]:
        tokens = tokens_of(text)
        n = len(tokens)

        def close(a: int, b: int) -> bool:
            gap = text[tokens[a][1] : tokens[b][0]]
            return len(gap) <= 2 and "\n" not in gap and not gap.strip()

        def initials(k: int) -> int:
            while k + 1 < n and tokens[k][3] == "w" and len(tokens[k][2]) == 1 and tokens[k][2].isupper() and tokens[k + 1][2] == "." and tokens[k + 1][0] == tokens[k][1]:
                k += 2
            return k

        def family(k: int) -> tuple[int, int] | None:
            """(next token, end) of a family name at token k."""
            m, prefix = k, ""
            while m < n and m - k < 3 and len(tokens[m][2]) < 4 and tokens[m][2].casefold() in PARTICLES and m + 1 < n and close(m, m + 1):
                prefix += tokens[m][2].casefold() + " "
                m += 1
            if m < n and tokens[m][3] == "w":
                word = tokens[m][2]
                for w in (word, _bare(word)) if word[-1:] == "s" else (word,):
                    if self._is(prefix + w, self.family):
                        return m + 1, tokens[m][0] + len(w)
            return None

        def given(k: int) -> bool:
            return k < n and tokens[k][3] == "w" and len(tokens[k][2]) > 1 and self._told(tokens[k][2])[0]

        def alike(a: int, b: int) -> bool:
            """Both words in capitals or both in small letters."""
            return tokens[a][2][0].isupper() and tokens[b - 1][2][0].isupper() or tokens[a][2].islower() and tokens[b - 1][2].islower()

        def strange(k: int) -> bool:
            return k < n and tokens[k][3] == "w" and self._told(tokens[k][2])[1]

        def titled(k: int) -> bool:
            """Two name-like words behind a title, as a seed."""
            t = k - 2 if k > 1 and tokens[k - 1][2] == "." else k - 1
            return t >= 0 and tokens[k][2][0].isalpha() and tokens[t][2].casefold() in TITLES and "\n" not in text[tokens[t][1] : tokens[k][0]] and k + 1 < n and tokens[k + 1][3] == "w" and close(k, k + 1) and _namelike(tokens[k][2]) and _namelike(_bare(tokens[k + 1][2]))

        k = 0
        while k < n:
            start = tokens[k][0]
            hit = None
            if tokens[k][3] == "w":
                first = initials(k)
                if given(k) or strange(k):
                    m = k + 1
                    if m < n and close(k, m):
                        m = initials(m)
                        if m < n and (m == k + 1 or close(m - 1, m)) and (hit := family(m)) and not given(k) and not alike(k, hit[0]):
                            hit = None
                elif first > k and first < n and close(first - 1, first):
                    hit = family(first)
                if hit is None and (f := family(k)) is not None:
                    m = f[0]
                    comma = m < n and tokens[m][2] == "," and tokens[m][0] == f[1]
                    g = m + 1 if comma else m
                    if g < n and f[1] == tokens[m - 1][1] and close(g - 1, g):
                        after = initials(g + 1) if given(g) and g + 1 < n and close(g, g + 1) else g + 1
                        if (given(g) or strange(g) and tokens[g][2][0].isupper() and (comma or tokens[m - 1][2].isupper())) and not (comma and after < n and close(after - 1, after) and family(after)):
                            hit = after, tokens[after - 1][0] + len(_bare(tokens[after - 1][2]))
                        elif comma and not given(g) and (h := initials(g)) > g:
                            hit = h, tokens[h - 1][1]
            if hit is None and tokens[k][3] == "w" and (titled(k) or _namelike(tokens[k][2]) and self._by_pattern(tokens, k, strange(k) and strange(k + 1))):
                hit = k + 2, tokens[k + 1][0] + len(_bare(tokens[k + 1][2]))
            if hit is None:
                k += 1
            else:
                yield start, hit[1]
                k = hit[0]
        if self.han is not None:
            for m in self.han.finditer(text):
                yield m.span()

    def _by_pattern(self, tokens: list[tuple[int, int, str, str]], k: int, unseen: bool = False) -> bool:
        """Two name-like words, one of them a known name or both never met as anything else, in a good pattern."""
        if k + 1 >= len(tokens) or tokens[k + 1][3] != "w" or tokens[k + 1][0] - tokens[k][1] != 1:
            return False
        a, b = tokens[k][2], _bare(tokens[k + 1][2])
        if not (_namelike(a) and _namelike(b)) or not (unseen or self._is(a, self.given) or self._is(b, self.family)):
            return False
        return max(self.learnt["name"].get(p, 0.0) for p in _around(tokens, k, k + 1)[:2]) >= 0.8


def _tagger(held) -> Tagger:
    """One tagger per process and broadcast."""
    if getattr(_tagger, "of", None) != held.id:
        _tagger.of, _tagger.made = held.id, Tagger(held.value)
    return _tagger.made


class _Held:
    def __init__(self, broadcast, id_: int) -> None:
        self.broadcast, self.id = broadcast, id_

    @property
    def value(self):
        return self.broadcast.value


def _hold(texts: DataFrame, learnt: dict[str, dict[str, float]]) -> _Held:
    b = texts.sparkSession.sparkContext.broadcast(learnt)
    return _Held(b, b._jbroadcast.id() if getattr(b, "_jbroadcast", None) else id(b))


def spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos, pii_type) of every text, by what all texts teach."""
    held = _hold(texts, learn(texts, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(held)
        for batch in batches:
            keys, starts, ends, kinds = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, j, kind in tagger.spans(t) if t else ():
                    keys.append(k)
                    starts.append(i)
                    ends.append(j)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string())], [key, "start_pos", "end_pos", "pii_type"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {kind}, start_pos int, end_pos int, pii_type string")


def redacted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with every span replaced by its type in brackets; null stays null."""
    held = _hold(texts, learn(texts, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(held)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                if t:
                    parts, at = [], 0
                    for i, j, kind in tagger.spans(t):
                        parts += [t[at:i], f"[{kind.upper()}]"]
                        at = j
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
