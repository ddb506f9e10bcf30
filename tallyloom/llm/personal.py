"""Personal data in free text: found on a normalised copy, replaced in the original.

A chain of *transducers* rewrites the text: look-alike characters, digits and at/dot written so
as to hide them. Each keeps, for every stretch it changed, where that stretch lay before, so that
a span found on the last copy is carried back to the characters of the source.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.workspace import staged

KINDS = ("email", "phone", "identity_number", "street_address", "name")

# -- normalisation ---------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter, which compatibility forms (NFKC) leave alone: script, letters, what they look like.
CONFUSABLES = (
    ("Cyrillic", "аеорсхуіјѕԁһԛԝѵӏкгп", "aeopcxyijsdhqwvlkrn"),
    ("Cyrillic capitals", "АВЕКМНОРСТХУІЈЅԚԜѴӀҒҮ", "ABEKMHOPCTXYIJSQWVIFY"),
    ("Greek", "αγηικνορτυχωσ", "aynikvoptuxwo"),
    ("Greek capitals", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("Armenian", "օոսհցզյՕՍՏԼ", "onuhgqjOUSL"),
    ("Cherokee", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("small capitals and others", "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢıɑɡ", "abcdefghijklmnoprstuvwyziag"),
    ("punctuation", "’‘ʼ。", "'''."),
)


class _Fold(dict):
    """One character for one, found when first asked for: compatibility forms, any script's digits, dashes, blanks, look-alikes."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        c = plain if len(plain) == 1 else c
        kind = unicodedata.category(c)
        if not c.isascii():
            if kind == "Nd":
                c = str(unicodedata.decimal(c))
            elif kind == "Pd" or c == "\u2212":
                c = "-"
            elif kind == "Zs":
                c = " "
        self[code] = ord(self.looks.get(c, c))
        return self[code]


_Fold.looks = {c: to for _, letters, like in CONFUSABLES for c, to in zip(letters, like, strict=True)}
_FOLD = _Fold()
#: Characters without a shape of their own: soft hyphens, joiners, marks of direction, variants of emoji.
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]+")
#: A letter with its accents set apart.
_ACCENTED = re.compile("[^\\W\\d_][\u0300-\u036f]+")

_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED = re.compile(rf"\b{_DIGIT}(?:[ \-.,]{{1,2}}{_DIGIT}){{5,}}\b", re.I)

#: Ways to write an at: signs with or without blanks around them, and what needs its blanks.
_AT_SIGNS, _AT_ALONE, _AT_BARE = (r"[\(\[{<]\s?(?i:at|@)\s?[\)\]}>]", "%40", "&#(?:64|x40);"), r"\s@\s", r"\s(?:AT|at)\s"
_AT_MARKED = rf"(?:\s?(?:{'|'.join(_AT_SIGNS)})\s?|{_AT_ALONE})"
_AT = rf"(?:{_AT_MARKED}|{_AT_BARE})"
_DOT = r"(?:\s?[\(\[{<]\s?(?i:dot|\.)\s?[\)\]}>]\s?|\s(?:DOT|dot)\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
#: local AT domain: with a plain at between blanks, the dots must be spelled too, or it is a sentence.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9_+\-]|\.(?=[A-Za-z0-9])|{_DOT}(?=[A-Za-z0-9])){{0,63}}?{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+",
)
_AT_ONE, _DOT_ONE = re.compile(_AT), re.compile(_DOT)
#: Each way alone, which is quick to look for; most texts have none of them.
_ATS = [re.compile(p) for p in (*_AT_SIGNS, _AT_ALONE, _AT_BARE)]
#: What every disguised address has from its at on: the same parts, but for the local part, which is slow to look for.
_HINT = re.compile(rf"(?<=[A-Za-z0-9_+\-])(?:{_AT_MARKED}{_LABEL}(?:\.|{_DOT}){_LABEL}|{_AT_BARE}{_LABEL}(?:\.{_LABEL})*{_DOT}{_LABEL})")
#: In every spelled number but those of ones and ohs alone, and what those begin with.
_RARE_DIGITS = ("zero", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_ONES = re.compile(r"(?:oh|one)[ \-.,]{1,2}(?:oh|one)")


class Normalised:
    """A text after transducers, with the way back for spans."""

    def __init__(self, source: str) -> None:
        self.text = source
        self._steps: list[tuple[list[int], list[tuple[int, int, int]]]] = []

    def characters(self, table: dict) -> Normalised:
        """Replace characters one for one."""
        self.text = self.text.translate(table)
        return self

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str | None]) -> Normalised:
        """Replace matches by ``to(match)``; None leaves a match as it is."""
        parts, ends, moves, at, grown = [], [], [], 0, 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None or new == m[0]:
                continue
            parts += [self.text[at : m.start()], new]
            begin = m.start() + grown
            grown += len(new) - (m.end() - m.start())
            moves.append((begin, begin + len(new), m.start()))
            ends.append((begin, m.end()))
            at = m.end()
        if moves:
            self.text = "".join([*parts, self.text[at:]])
            self._steps.append(([b for b, _, _ in moves], [(b, e, s, src) for (b, e, s), (_, src) in zip(moves, ends, strict=True)]))
        return self

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        """The characters of the source behind start..end of the text as it is now."""
        for begins, moves in reversed(self._steps):
            start, end = self._back(begins, moves, start, False), self._back(begins, moves, end, True)
        return start, end

    @staticmethod
    def _back(begins: list[int], moves: list[tuple], at: int, is_end: bool) -> int:
        i = bisect.bisect_right(begins, at - 1 if is_end else at) - 1
        if i < 0:
            return at
        begin, end, source, source_end = moves[i]
        if at < end or (is_end and at == end):
            if at == begin and not is_end:
                return source
            # Within a stretch of the same length characters match one for one; else the stretch moves as a whole.
            if source_end - source == end - begin:
                return source + at - begin
            return source_end if is_end else source
        return source_end + at - end


def _plain_digits(m: re.Match) -> str:
    return "".join(_DIGIT_WORDS[w.lower()] for w in re.findall(_DIGIT, m[0], re.I))


def _plain_address(m: re.Match) -> str | None:
    whole = m[0]
    at = _AT_ONE.search(whole)
    if at is None:
        return None
    # "meet at forge.example" is no address: a bare at needs a spelled dot.
    if at[0].strip() in ("at", "AT") and not _DOT_ONE.search(whole[at.end() :]):
        return None
    return _DOT_ONE.sub(".", whole[: at.start()]) + "@" + _DOT_ONE.sub(".", whole[at.end() :])


def normalise(source: str) -> Normalised:
    """Look-alikes, invisible characters, spelled digits and disguised addresses made plain."""
    n = Normalised(source)
    if not source.isascii():
        n.rewrite(_INVISIBLE, lambda m: "").rewrite(_ACCENTED, lambda m: unicodedata.normalize("NFC", m[0]))
        # Ligatures and the like stand for several plain characters.
        wide = {c: w for c in set(n.text) if len(w := unicodedata.normalize("NFKC", c)) > 1 and w.isascii() and w.isprintable()}
        if wide:
            n.rewrite(re.compile(f"[{re.escape(''.join(sorted(wide)))}]"), lambda m: wide[m[0]])
        n.characters(_FOLD)
    low = n.text.lower()
    if any(p.search(n.text) for p in _ATS) and _HINT.search(n.text):
        n.rewrite(_DISGUISED, _plain_address)
    # Substring tests are many times faster than patterns, and most texts pass none of them.
    if any(w in low for w in _RARE_DIGITS) or _ONES.search(low):
        n.rewrite(_SPELLED, _plain_digits)
    return n


# -- detection -------------------------------------------------------------------------------

_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+"
_MAIL_HOST = re.compile(rf"@{_HOST}(?![A-Za-z0-9@])")
#: Accounts of programs rather than persons, at the start of an address.
_SERVICE = re.compile(r"(?i)(?:git|svn|hg|svc|ssh|www|root|no-?reply|do-?not-?reply|postmaster|mailer-daemon)@")
_PACKAGE = re.compile(r"@\d+(?:\.\d+)*(?:[\-.][0-9A-Za-z]+)*$|@\dx\.|\.(?:png|jpe?g|gif|svg|webp|ico)$")


def _behind(pattern: str) -> Callable:
    """What is to stand before a place, matched from there backwards: as far as it reaches, and no further is read."""
    compiled = regex.compile(f"(?mr){pattern}")
    return lambda text, at: compiled.match(text, 0, at)


#: A URL up to its user or password, which what follows ends; a user may be written as a placeholder, and a password have an at.
#: Its signs stand in sets with one that no text has: a fixed string would be looked for in all of the text before anything is matched.
_USERINFO = _behind(r"""[:\uffff][/\uffff][/\uffff](?:\$?\{[\w.\-]+\}|\$\([\w.\-]+\)|<[\w.\-]+>)?[^\s"'`,;()\[\]{}<>/?\#|\\@]*(?:@[^\s"'`,;()\[\]{}<>/?\#|\\@.]*)*""")
_MESSAGE_ID = _behind(r"(?i:\b(?:message|msg)[ \-_]?id:?|\bin-reply-to:|\breferences:)[^\S\n]*<?")
#: Before an at, the whole run of signs that an address may have.
_LOCAL = _behind(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_+\-])?")
_MAILTO, _FIELD = _behind(r"(?i:mailto):"), _behind(r"(?i:[a-z]\w*) ?:")

#: Where a long number lies; what it is, is asked at its start and the starts of its groups only.
_LONG_NUMBER = re.compile(r"\d(?:[ .()/+\-]{0,3}\d){5,}")
_GROUP = re.compile(r"(?:tel:\+?|\(?\+|\(|QQ |[A-Z]{1,2} ?)?\d+")
_D = r"(?<![\w.+/#@\-])"
_E = r"(?![\w@]|[.\-:/+]\d)"
#: What may stand before a number that is neither a phone nor an identity number.
_THING = _behind(
    r"(?i:\b(?:(?:lot|part|serial|checksum|crc|hash|digest|catalogue|catalog|build|release|version|revision|timeout|invoice|sku|isbn|uuid|sha\d*|md5)"
    r"(?:[^\S\n]+(?:item|no|nr|num|number|id|code))?\.?[^\S\n]*[:=#]?[^\S\n]*[\"'<(]?"
    r"|(?:item|batch|order|ticket|issue|model|key|port|bind|offset|size|seed|rev|dsn)(?:[^\S\n]+(?:no|nr|num|number|id|code))?\.?[^\S\n]*(?:[:#=][^\S\n]*)?))"
)
_PHONE = re.compile(
    _D
    + r"(?:(?:tel:)?\+\d(?:[ .\-/]?(?:\(\d{1,4}\)|\d)){8,13}"
    + r"|(?:1[ .\-])?\([2-9]\d{2}\)[ .\-]?[2-9]\d{2}[ .\-]\d{4}"
    + r"|(?:1[ .\-])?[2-9]\d{2}([ .\-])[2-9]\d{2}\1\d{4}"
    + r"|\(?0\d{4}\)?[ \-]\d{3}[ \-]?\d{3}|\(?0\d{3}\)?[ \-]\d{3}[ \-]\d{4}|\(?0\d{2}\)?[ \-]\d{4}[ \-]\d{4}"
    + r"|0\d{1,4}/ ?\d{5,9}|0[1-9](?:[ .\-]\d{2}){4}"
    + r"|(?P<bare>0\d{9,10}|1?[2-9]\d{2}[2-9]\d{6}))(?: ?(?:ext|x|extension)\.? ?\d{1,6})?"
    + _E
)
#: What must stand before a number without any signs of a phone.
_CALL = _behind(r"(?i:\b(?:tel|phone|telephone|mobile|cell|fax|call|ring|pager|dial|sms|ph)\b[ .:=/]*(?:no\.?|number)?[ :=]*[\"'(]?)")

_NUMBER = r"(?:[^\S\n]+|-)(?:number|no|nr)"
_ID_WORD = (
    rf"(?:ssn|social[ \-]security(?:{_NUMBER})?|personnummer|person{_NUMBER}|national[ \-](?:id|insurance|identity)(?:{_NUMBER})?|insurance{_NUMBER}|"
    rf"identity(?:{_NUMBER}|[ ]card)|id{_NUMBER}|id[ ]card|(?:passport|travel[ ]document)(?:{_NUMBER})?|nino|ni{_NUMBER}|tax[ ]id|cpr|fnr)"
)
_LABEL_BEFORE = _behind(rf"(?i:(?<!\w){_ID_WORD}\.?[^\S\n]*[:=#]?[^\S\n]*[\"'(]?)")
_LABELLED = re.compile(
    r"(?i)(?:[A-Z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-D]|\d{6,8}[ \-+]?\d{4}|\d{3}[ \-.]?\d{2}[ \-.]?\d{4}|[A-Z]{1,2}\d{6,8}|\d{7,9})(?![\w]|-\d)"
)
_BARE_ID = re.compile(
    rf"{_D}(?:\d{{3}}-\d{{2}}-\d{{4}}|(?:19|20)?\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\-+]\d{{4}}"
    rf"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] \d{{2}} \d{{2}} \d{{2}} [A-D]|QQ \d{{2}} \d{{2}} \d{{2}} [A-D]){_E}"
)

#: All capitals of the Latin script.
_UPPER = "A-Z" + "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.isupper())
_CAP = rf"[{_UPPER}](?:[\w'’\-]*[\w])?"
#: What every address with its number first has; the same for the gates of the other patterns below.
_HOUSE = re.compile(r"\d{1,5}(?:[a-dA-D]| ?(?:bis|ter|BIS|TER))?,? [^\W\d_]")
_SUFFIX = (
    r"(?i:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Close|Court|Ct|Place|Pl|Square|Sq|Terrace|Crescent|Parkway|Pkwy|Highway|Hwy|Circle|Row|Walk|Mews|Alley|Grove|Hill|Quay)"
)
_UNIT = r"\d{1,5}(?:[a-dA-D]\b| ?(?:bis|ter|BIS|TER)\b)?"
_REST = (
    rf"(?:, (?:(?i:apt|apartment|unit|flat|suite|ste|floor)\.? ?#? ?\w+|# ?\d+\w*))?"
    rf"(?:, (?:\d{{4,5}} )?{_CAP}(?:[ \-]{_CAP})?(?:,? (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,3}}\d{{1,2}} \d[A-Z]{{2}}))?)?"
)
_NUMBER_FIRST = re.compile(
    rf"(?<![\w.\-/:]){_UNIT}(?:"
    rf" {_CAP}(?: {_CAP}){{0,2}}? {_SUFFIX}\b\.?"
    rf"|,? (?i:rue|chemin|avenue|impasse|boulevard|allée|place|route|quai|cours|via|calle|piazza|rua) (?:(?i:de la|de l'|du|des|de|d'|della|del|dei|da|do) ?)?[\w'’\-]+(?: {_CAP}){{0,2}}"
    rf"){_REST}"
)
_STREET_WORDS = ("straße", "strasse", "str.", "weg ", "platz ", "gasse ", "allee ", " ring ", "ufer ", "damm ")
#: Prepositions that begin a street's name, with the capital they have there: in the lower case of running text they mean nothing.
_STREET_PREPOSITIONS = re.compile(
    r"[ABHIUVZ](?<!\w.)(?:(?<=[AI])[mM] |(?<=[AI])[nN] [dD][eE]|(?<=A)[uU][fF] [dD][eE]|(?<=Z)[uU][mMrR] |(?<=B)[eE][iI][mM] |(?:(?<=U)[nN][tT]|(?<=H)[iI][nN][tT])[eE][rR] [dD][eE]|(?<=V)[oO][rR] [dD][eE])"
)
_STREET_FIRST = re.compile(
    rf"(?<![\w.\-/])(?:(?=[A-Z])(?i:am|an der|an den|im|in der|in den|auf dem|auf der|zum|zur|beim|unter den|hinter der|vor dem) {_CAP}|(?=[{_UPPER}])[\w\-]+?(?i:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm)|{_CAP} (?i:Allee|Straße|Strasse|Weg|Platz|Gasse|Ring|Ufer|Damm))"
    rf" \d{{1,4}}(?: ?[a-dA-D]\b)?(?![\w\-]|\.\d){_REST}"
)

_TITLE = r"(?:(?i:mr|mrs|ms|miss|dr|prof|sir|mx)\b\.? +)?"
_INITIAL = rf"[{_UPPER}]\."
_O = r"[OD](?:''|\\'|\\\"|\")[A-Z][\w\-]+"
_NAME = rf"{_TITLE}(?:{_INITIAL}|{_CAP})(?: +{_INITIAL})* {{1,2}}(?:{_O}|{_CAP})"
_TURNED = rf"(?:{_O}|{_CAP}), {{1,2}}{_TITLE}(?:{_INITIAL}|{_CAP})(?: {_INITIAL})*"
_ALONE = r"(?<![\w.@/\-])(?<!\w['’])"
#: The same, but asked after the capital, which is quicker to look for.
_CAPITALS = re.compile(rf"[{_UPPER}](?<![\w.@/\-].)(?<!\w['’].)[\w'’.\-]*+(?:(?:''|\\['\"]|\")[A-Z][\w\-]+)?,? +[{_UPPER}]")
_PERSON = re.compile(rf"{_ALONE}(?:(?P<turned>{_TURNED})|{_NAME})(?![\w@/(]|\.\w|-\w|[ ]?=[^=])")
#: Name fields that stand apart: family and given name (or the reverse) as two quoted values.
_APART = re.compile(rf"""(?P<q>["'])(?P<name>(?:{_O}|{_CAP})(?P=q), ?(?P=q)(?:{_INITIAL}|{_CAP}))(?P=q)(?=, ?(?P=q)(?P<third>))""")

#: What introduces a person.
_BEFORE = _behind(
    r"(?i:(?<!\w)(?:co-?developed-by|co-?authored-by|signed-off-by|reviewed-by|acked-by|tested-by|reported-by|suggested-by|maintainers?|authors?|from|to|cc|contact|owner|reviewer|assignee|name|attn|patient|customer|employee)[\"']? ?[:=] ?[\"']?"
    r"|@author[ \t]+|\b(?:written|created|reported|reviewed|maintained|fixed) by +|\bthanks to +|\b(?:todo|fixme|please),?:? ask +|\bpatient +|\bdear +|\bcredits? to +)[ \t]*"
)
_COPYRIGHT = _behind(r"(?i:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©)?[ \t]*(?:\d{4}(?:[ \t]*[-,][ \t]*\d{4})*,?)?[ \t]*(?:by[ \t]+)?)")
#: The beginning of a line: signs of a comment or list, and a key or a variable with its opening quote.
_SIGNS = r"[ \t/#*>;%!<\-]*"
_KEY = r"""(?:["'][\w \-]+["'][ ]?:[ ]?["']|(?:[\w<>\[\]]+[ ]+)*[\w.]+[ ]?(?::=|[:=])[ ]?["'])?"""
_LEAD, _NEXT_LEAD = _behind(rf"^{_SIGNS}{_KEY}"), re.compile(rf"{_SIGNS}{_KEY}")
_QUOTED = _behind(r"""[(\[{,=:][ ]?["']""")
_ADDRESS_TAIL = re.compile(r"[ \t]*<(?:mailto:|[^<>\n@]*@)|[ \t]*\([^()\n@]*@")
_FOLLOWS = re.compile(r"""["']?,[ ]?["']?(?:mailto:|tel:)?""")
_ORGANISATION = re.compile(r"(?i)[ ,]+(?:ltd|inc|gmbh|llc|labs?|works|systems|foundation|contributors|corp)\b")
_LINE_END = re.compile(r"[ \t\"';,]*\r*(?:\n|$(?!\n))")
#: Words that make capitals an organisation or a thing rather than a person.
_NO_PERSON = re.compile(
    r"(?i)\b(?:ltd|inc|gmbh|llc|plc|corp|corporation|company|co|labs?|works|systems|foundation|contributors|authors|project|team|group|software|technologies|university|institute|society|community|limited|partners|studio|solutions|consortium|the|and|all|rights|reserved)\b"
)
_WORD = re.compile(r"[\w'’\-]+")


class NameList:
    """Given and family names, in lower case: a help where no context speaks, not a limit."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        clean = [(n.strip().lower(), k) for n, k in rows if n and n.strip()]
        self.given = {n for n, k in clean if k == "given"}
        self.family = {n for n, k in clean if k == "family"}

    def pair(self, name: str) -> tuple[str, str] | None:
        """Given and family name of a name whose two ends are listed."""
        words = _WORD.findall(name.lower())
        first, last = (words[-1], words[0]) if "," in name else (words[0], words[-1])
        return (first, last) if first in self.given and last in self.family else None

    def listed(self, name: str) -> list[str]:
        return [w for w in _WORD.findall(name.lower()) if w in self.given or w in self.family]


class Found:
    """Pieces of one text, kept apart and in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[tuple[int, int, str, tuple[str, str] | None]] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return not (i and self.ends[i - 1] > start)

    def take(self, start: int, end: int) -> bool:
        """Keep others from start..end; False if part of it is taken."""
        if not self.free(start, end):
            return False
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True

    def add(self, start: int, end: int, kind: str, pair: tuple[str, str] | None = None) -> bool:
        if not self.take(start, end):
            return False
        self.pieces.append((start, end, kind, pair))
        return True


def detect(text: str, names: NameList) -> list[tuple[int, int, str, tuple[str, str] | None]]:
    """Pieces of personal data in a normalised text, apart, in order: (start, end, kind, pair).

    ``pair`` is None, or the two listed words of a name that nothing but the list speaks for. Time
    grows with the length of the text, whatever is found in it: contexts are matched from a place
    outwards, and pieces are kept sorted.
    """
    found = Found()
    at = text.find("@")
    while at >= 0:
        local, host = _LOCAL(text, at), _MAIL_HOST.match(text, at)
        if local and host:
            start, end = local.start(), host.end()
            piece, last = text[start:end], text[start - 1 : start]
            spared = (
                _SERVICE.match(piece)
                or _PACKAGE.search(piece)
                or _USERINFO(text, start)
                or _MESSAGE_ID(text, start)
                or (text[end : end + 1] == ":" and text[end + 1 : end + 2].isalnum() and not _MAILTO(text, start))
                or last == "/"
                or (last == ":" and not _FIELD(text, start))
            )
            if spared:
                found.take(start, end)
            else:
                found.add(start, end, "email")
        at = text.find("@", at + 1)
    for run in _LONG_NUMBER.finditer(text):
        for g in _GROUP.finditer(text, max(0, run.start() - 6), run.end()):
            for at in (g.start(), g.end() - len(g[0].lstrip("tel:+(QABCDEFGHIJKLMNOPRSTUVWXYZ "))):
                if found.free(at, at + 1) and (hit := _number_at(text, at)):
                    found.add(*hit)
    addresses = set()
    for m in _HOUSE.finditer(text):
        if (m := _NUMBER_FIRST.match(text, m.start())) and found.add(m.start(), m.end(), "street_address"):
            addresses.add(m.start())
    low = text.lower()
    if any(w in low for w in _STREET_WORDS) or _STREET_PREPOSITIONS.search(text):
        for m in _STREET_FIRST.finditer(text):
            if found.add(m.start(), m.end(), "street_address"):
                addresses.add(m.start())
    _add_names(text, names, found, addresses)
    return sorted(found.pieces)


def _number_at(text: str, at: int) -> tuple[int, int, str] | None:
    """The identity or phone number that begins at a place, if one does."""
    if (m := _LABELLED.match(text, at)) and _LABEL_BEFORE(text, at):
        return m.start(), m.end(), "identity_number"
    bare, phone = _BARE_ID.match(text, at), _PHONE.match(text, at)
    if not (bare or phone) or _THING(text, at):
        return None
    if bare:
        return at, bare.end(), "identity_number"
    if phone["bare"] and not _CALL(text, at):
        return None
    return at, phone.end(), "phone"


def _add_names(text: str, names: NameList, found: Found, addresses: set[int]) -> None:
    known = set(found.starts)
    for m in _APART.finditer(text) if known else ():
        if m.start("third") in known and not _NO_PERSON.search(m["name"]):
            found.add(m.start("name"), m.end("name"), "name")
    at = 0
    while scan := _CAPITALS.search(text, at):
        at = scan.start() + 1
        # A title stands before the name; letters before it make it part of a word.
        m = _PERSON.match(text, scan.start())
        if m is None:
            continue
        start, end, name = m.start(), m.end(), m[0]
        at = end
        if _NO_PERSON.search(name):
            at = start + 1
            continue
        if _ORGANISATION.match(text, end):
            continue
        # The next field is a mail address, number or street.
        follows = _FOLLOWS.match(text, end)
        fielded = follows and (follows.end() in known or end + len(follows[0].removesuffix("tel:").removesuffix("mailto:")) in known)
        pair = None if m["turned"] else names.pair(name)
        if (
            (not m["turned"] and _ADDRESS_TAIL.match(text, end))
            or _BEFORE(text, start)
            or (_COPYRIGHT(text, start) and not m["turned"])
            or (fielded and (_LEAD(text, start) or _QUOTED(text, start)))
            or (_LINE_END.match(text, end) and _LEAD(text, start) and _block(text, end, addresses))
        ):
            found.add(start, end, "name")
        elif pair:
            found.add(start, end, "name", pair)
        else:
            # "Brantel, Ulrike Jablonek <...", "Dear Ulrike Jablonek": the second word may begin a name of its own.
            at = start + 1


def _block(text: str, end: int, addresses: set[int]) -> bool:
    """Whether an address or phone stands alone on the line after the one that ends here."""
    line = text.find("\n", end) + 1
    if not line:
        return False
    return _NEXT_LEAD.match(text, line).end() in addresses


# -- the operator ----------------------------------------------------------------------------


def find_pieces(source: str, names: NameList) -> tuple[list[tuple[int, int, str, tuple[str, str] | None]], dict[str, list[int]]]:
    """Pieces as spans of the source, apart and in order, and for each listed word how often it was part of a name with a context and of one without."""
    n, out, seen, at = normalise(source), [], {}, 0
    for start, end, kind, pair in detect(n.text, names):
        if kind == "name":
            for w in pair or names.listed(n.text[start:end]):
                seen.setdefault(w, [0, 0])[pair is not None] += 1
        start, end = n.source_span(start, end)
        # A piece that begins within a rewritten stretch comes back as the whole stretch: what an earlier piece has is left to it.
        start = max(start, at)
        if start < end:
            out.append((start, end, kind, pair))
            at = end
    return out, seen


def find_personal(source: str, names: NameList, plain: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Pieces of personal data in a text, as spans of its own characters: (start, end, kind); two ``plain`` words are a name only in a context."""
    return [(s, e, k) for s, e, k, pair in find_pieces(source, names)[0] if not (pair and plain.issuperset(pair))]


def redact(source: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each piece replaced by ``[KIND]``; all else stays as it is."""
    parts, at = [], 0
    for start, end, kind in found:
        parts += [source[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, source[at:]])


def is_plain(proven, bare):
    """Whether a listed word stands without a context more often than chance would have it: by over two standard deviations."""
    return (bare > proven) & ((bare - proven) * (bare - proven) > 4 * (bare + proven))


_LISTED = "array<struct<kind: string, start: long, end: long, line_no: long>>"
_HELD = "doc_id long, text string, pieces array<struct<kind: string, start: long, end: long, line_no: long, given: string, family: string>>, seen array<struct<word: string, proven: long, bare: long>>"


def personal_data(df: DataFrame, name_list: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 200_000, with_text: bool = True) -> DataFrame:
    """Texts with personal data replaced: doc_id, text, pieces (array of kind, start, end, line_no).

    ``start`` and ``end`` are character offsets in the original, ``line_no`` counts from 1 at
    ``\\n``. Every document gives a row; null texts stay null without pieces, empty texts empty.
    Placeholders are ``[EMAIL]``, ``[PHONE]``, ``[IDENTITY_NUMBER]``, ``[STREET_ADDRESS]`` and
    ``[NAME]``. Repeated rows give repeated rows; columns other than those named are dropped.
    Without ``with_text`` there is no text column, and texts are not written either.

    ``name_list`` (name_text, name_kind) must have at most ``limit`` rows, as it is sent to all
    tasks; without it names are found by their context alone. Two listed words without a context
    are a name unless both are plain words *in this collection*: for each listed word it is counted
    over all documents how often it is part of a name that a context proves and how often it
    stands in such a pair without one (``is_plain``).

    Texts are scanned once, whole, in Arrow batches; what was found is written to the shared folder,
    the words are counted, at most as many as are listed, and the pairs are settled. Texts are
    never shuffled.
    """
    rows = name_list.select("name_text", "name_kind").dropna().distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} names")
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast([(r[0], r[1]) for r in rows])
    token = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _lists:
            _lists.clear()
            _lists[token] = NameList(shared.value)
        names = _lists[token]
        for pdf in batches:
            pieces, seen = [], []
            for t in pdf["text"]:
                found, words = find_pieces(t, names) if t else ([], {})
                at, line, listed = 0, 1, []
                for start, end, kind, pair in found:
                    line += t.count("\n", at, start)
                    at = start
                    given, family = pair or (None, None)
                    listed.append({"kind": kind, "start": start, "end": end, "line_no": line, "given": given, "family": family})
                pieces.append(listed)
                seen.append([{"word": w, "proven": p, "bare": b} for w, (p, b) in words.items()])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pdf["text"] if with_text else None, "pieces": pieces, "seen": seen})

    chosen = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = staged(chosen.mapInPandas(scan, _HELD), "personal")
    words = held.select(F.explode("seen").alias("s")).groupBy("s.word").agg(F.sum("s.proven").alias("proven"), F.sum("s.bare").alias("bare"))
    plain = sc.broadcast(frozenset(r[0] for r in words.where(is_plain(F.col("proven"), F.col("bare"))).select("word").collect()))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, pieces = [], []
            for i, found in enumerate(pdf["pieces"]):
                kept = [p for p in found if p["given"] is None or not (p["given"] in plain.value and p["family"] in plain.value)]
                pieces.append([{k: p[k] for k in ("kind", "start", "end", "line_no")} for p in kept])
                if with_text:
                    t = pdf["text"].iloc[i]
                    texts.append(redact(t, [(p["start"], p["end"], p["kind"]) for p in kept]) if len(kept) else t)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **({"text": texts} if with_text else {}), "pieces": pieces})

    if with_text:
        return held.select("doc_id", "text", "pieces").mapInPandas(settle, f"doc_id long, text string, pieces {_LISTED}")
    return held.select("doc_id", "pieces").mapInPandas(settle, f"doc_id long, pieces {_LISTED}")


_lists: dict[str, NameList] = {}


def personal_lines(redacted: DataFrame) -> DataFrame:
    """Of ``personal_data``: doc_id, kind, line_no, one row per document, kind and line on which a piece begins."""
    return redacted.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.kind", "p.line_no").distinct()
