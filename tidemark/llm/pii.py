"""Personal information in free text: anchors by Aho-Corasick, then local parsers that expand and validate a span.

One pass of the automaton over the lower-cased text finds at-signs (also spelt out), identifier and street cues, given
names, titles, phrases that introduce people, and the endings of surnames where such were learned (see names.py). Each
hit hands its place to the parser of its kind, which reads outwards from it, as far as the thing goes, and decides on
the span. Numbers in telephone shape are their own anchors. A parser never reads what the one before it has read, so
the cost of a text is linear in its length, whatever stands in it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable

import ahocorasick

KINDS = ("email", "phone", "id_number", "address", "name")

# ---- fixed values: cues and shapes ----------------------------------------------------------------------------------
AT_SIGNS = ("@", "＠", "%40", "(at)", "[at]", "{at}", "<at>", " at ")
ID_CUES = (
    "ssn", "social security", "social insurance", "national insurance", "ni number", "nino", "steuer-id", "steuerid", "steueridentifikationsnummer", "steuernummer",
    "sozialversicherungsnummer", "dni", "nie", "nif", "passport", "reisepass", "passeport", "pasaporte", "id card", "identity card", "personalausweis",
    "ausweis", "carte d'identité", "cédula", "tax id", "tax number", "taxpayer", "tin", "national id", "numéro de sécurité sociale", "número de identidad", "cpf", "bsn", "pesel",
)
# What opens or closes an address, by the pattern that reads it.
STREET_CUES = {
    "en": ("street", "avenue", "lane", "road", "drive", "close", "court", "square", "terrace", "boulevard", "crescent", "grove", " way", " hill", " place", " st", " rd", " ave", " ln", " dr", " blvd"),
    "de": ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ring", "ufer"),
    "fr": ("rue ", "avenue ", "boulevard ", "chemin ", "impasse ", "quai ", "cours ", "place ", "allée "),
    "es": ("calle ", "c/", "avenida ", "avda", "plaza ", "paseo ", "camino ", "via "),
    "box": ("box", "postfach", "apartado", "boîte postale", "boite postale", "casilla", "b.p."),
}
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "señor", "señora", "sr", "sra", "mme", "monsieur", "madame", "don", "doña")
# Widespread given names of several languages, beside those the hub knows.
COMMON_GIVEN = frozenset(
    "agnieszka ahmed aisha alejandro alexander amanda andreas andrew angela anjali anna anthony astrid barbara benjamin betty bjorn brandon brian carmen catherine charles christine christopher cynthia daniel david deborah deepak "
    "dennis diane dmitri donna edward elena elizabeth emily emma eric erik fatima francesca françois george giulia gregory hans heather helen hiroshi isabelle ivan jacob james janet jason javier jeffrey jennifer jessica joan john "
    "jonathan joseph joshua joyce julia julie karen katarzyna katherine kathleen kenji kenneth kevin kimberly klaus krzysztof lars laura lena linda lisa luca lucía margaret maria marco mary matthew matthias melissa michael michelle "
    "miguel mohammed monika nancy natasha nathalie nicholas nicole olga olivia omar pablo patricia patrick peter petra pierre piotr rachel rahul rebecca richard robert ronald ryan sabine samantha samuel sandra sanjay sarah sharon "
    "sofia sophie stefan stephanie stephen steven susan sven svetlana thomas timothy ursula victoria wei william wolfgang yuki yusuf".split()
)
# Phrases after which a capitalised word that is not known is a person's name. After "written by" and the like it is a
# tool's as often; there only known names count.
PAIR_CUES = ("pair with", "pairing with", "paired with", "spoke with", "speak with", "talked to", "met with", "cc", "hi", "hello", "dear")
# Capitalised words that follow a title or such a phrase and are no name.
NO_NAMES = frozenset(
    "all team teams everyone everybody folks friends colleague colleagues customer customers user users support security operations infra platform infrastructure sir madam president chair director minister committee council "
    "world github gitlab claude copilot codex chatgpt gpt spark python java rust docker kubernetes linux windows mac postgres sqlite redis kafka slack jira the this that these those there we you they it he she who what "
    "no not none and or but if then thanks please alle zusammen team kollegen kunden kunde nutzer tous toutes equipo todos monday tuesday wednesday thursday friday saturday sunday "
    "january february march april may june july august september october november december doktor professor engineering product design legal finance marketing sales management leadership data backend frontend".split()
)
# Phrases after which two capitalised words that are not known, or an initial and one, are a person's name.
INTRODUCTIONS = (
    "thanks to", "according to", "reported by", "reported-by:", "reviewed by", "reviewed-by:", "approved by", "acked-by:", "opened by", "signed by", "signed-off-by:", "written by", "author:", "author=", "assignee:", "attn:", "contact:", "i met", "ask", "asked by", "by",
    "bitte bei", "danke an", "warten auf", "warten noch auf", "von", "merci à", "demande à", "gracias a",
)
# Words before a place, not a person.
LOCATIVES = frozenset("in at near around im nach aus zu à en dans near outside to via".split())
# Given names that are ordinary words too: alone they are no name unless a cue of a person precedes.
WORDLIKE = frozenset("mark rose will grace hope joy may april june frank art bill jack rob sue pat dawn faith ivy lily ruby pearl amber iris summer autumn max ray dean chase guy".split())

LEAST_SURNAME = 5  # letters of a surname that its ending alone tells

_LETTER = r"[^\W\d_]"
_WORD = rf"{_LETTER}+(?:['’]{_LETTER}+)?(?:-{_LETTER}+)*"
_CAPITALISED = re.compile(rf"[A-ZÀ-Þ](?:['’][A-ZÀ-Þ])?{_LETTER}+(?:-{_LETTER}+)?(?![\w])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_DOT = r"(?:\.|[ ]*(?:\(dot\)|\[dot\]|\{dot\}|\(punkt\)|\[punkt\])[ ]*|[ ]+dot[ ]+)"
_SPELT_HOST = re.compile(rf"[ ]*[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}\b", re.I)
_PHONE = re.compile(r"(?<![\w./:@#=+-])(?:\+|\(\+)?[\d(](?:[ ./() -]{0,2}\d){6,16}(?![\w@])|(?<=[=:;,(\"'>])(?:\+)?[\d(](?:[ ./() -]{0,2}\d){6,16}(?![\w@])")
_PHONE_CUE = re.compile(r"(?i)(?:tel|telephone|telefon|teléfono|téléphone|phone|mobile|handy|cell|fax|call|ring|sms|text|whatsapp|llámame|rufnummer)[\w'\"]{0,3}\W{0,6}(?:\w{1,4}\W{1,2}){0,3}$")
PHONE_CUE_REACH = 40  # no match of the pattern is longer: 9 + 3 + 6 + 3 * 6
_NANP = re.compile(r"(?:\(\d{3}\) ?|\d{3}[.\- ])\d{3}[.\-]\d{4}$")
_TRUNK = re.compile(r"0\d{2,4}[ /-]\d{3,}(?:[ /-]?\d+)*$")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}$")
_ID_VALUE = re.compile(r"(?:[\s:#=.'\"(\[]|\bno\b|\bnr\b|\bn[º°]|\bnumber\b|\bnumero\b|\bnúmero\b|\bnuméro\b|\bis\b|\bist\b|\bes\b|\best\b)*([A-Za-z]{0,3}[ -]?\d[\dA-Za-z]*(?:[ -]\d[\dA-Za-z]*)*(?:[ -][A-Za-z](?![A-Za-z]))?|[A-Z][A-Z0-9]{5,})", re.I)
_NUM = r"\d{1,5} ?[a-zA-Z]?(?:[-/]\d{1,4})?"
_EN_STREET = re.compile(rf"(?i)\b{_NUM},? +(?:(?:north|south|east|west|n|s|e|w)\.? +)?{_LETTER}[\w'’-]*(?: {_LETTER}[\w'’-]*)?? +(?:street|avenue|lane|road|drive|close|court|square|terrace|boulevard|crescent|grove|way|hill|place|st|rd|ave|ln|dr|blvd)\b")
_DE_STREET = re.compile(rf"(?i)(?<![\w-]){_LETTER}[\w-]+(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ring|ufer) +{_NUM}(?!\w)|(?<![\w-]){_LETTER}+ (?:straße|strasse|str\.|weg|gasse|platz|allee) +{_NUM}(?!\w)")
_FR_STREET = re.compile(rf"(?i)\b\d{{1,5}}(?: ?(?:bis|ter))?,? +(?:rue|avenue|boulevard|place|impasse|allée|chemin|quai|cours) +(?:(?:de la|de l'|du|des|de|d') *)?{_LETTER}[\w'’-]+")
_ES_STREET = re.compile(rf"(?i)\b(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|via) *(?:de (?:la |los |las )?)?{_LETTER}[\w'’-]+(?: {_LETTER}[\w'’-]+)?,? +(?:n[º°.] ?)?\d{{1,5}}(?!\w)")
_BOX = re.compile(r"(?i)(?:\bp\.? ?o\.? ?box|\bpostfach|\bapartado(?: de correos| postal)?|\bbo[iî]te postale|\bcasilla(?: postal)?|\bb\.p\.)[ #:.]*\d[\d ]{0,6}\d?|\bpost box \d+")
_STREETS = {"en": _EN_STREET, "de": _DE_STREET, "fr": _FR_STREET, "es": _ES_STREET, "box": _BOX}
# What matters before a mail address on its line: where a word starts, a scheme, a remote shell, the end of its command.
_LEFT = re.compile(r"(?P<stop>[\n|;&])|(?P<word>[^\S\n])|(?P<scheme>://)|(?P<shell>(?<![^\s\"'`(|;&$])(?:ssh|scp|rsync|sftp|mosh|sshpass|ssh-copy-id)(?=\s))")
_REMOTE_PATH = re.compile(r":[\w~./-]+")
_PROMPT = re.compile(r":[~/][^\n@#$]*[#$]")
_SPELT_AT = re.compile(r"[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+\b", re.I)
_NEXT = re.compile(rf"[ \u00a0]((?:{_LETTER}\.[ \u00a0]?)*)({_WORD})(?![\w@/\\(]|\.\w)")
_TWO = re.compile(rf"[:=]?[ ]*[\"']?((?:{_LETTER}\.[ ]?)+|{_CAPITALISED.pattern}(,?)[ ](?:{_LETTER}\.[ ]?)*)({_CAPITALISED.pattern})(?![\w@/\\(]|\.\w)")
_TITLED = re.compile(rf"(?:{_LETTER}\.[ ]?)?([A-ZÀ-Þ](?:['’][A-ZÀ-Þ])?{_LETTER}+(?:-{_LETTER}+)?)")
_COMMA_NAME = re.compile(rf",[ ](?:{_LETTER}\.[ ]?)?({_WORD})")


class _Line:
    """What stands to the left of the at-signs of a text, which come in order; no character is read twice."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.scheme, self.shell = text, 0, -1, False

    def upto(self, to: int) -> None:
        start = max(self.at, self.text.rfind("\n", self.at, to))
        for m in _LEFT.finditer(self.text, start, to):
            if m["scheme"]:
                self.scheme = m.start()
            elif m["shell"]:
                self.shell = True
            elif m["stop"]:
                self.shell = False
                if m[0] == "\n":
                    self.scheme = -1
            else:
                self.scheme = -1
        self.at = max(self.at, to)


class Finder:
    """Holds the automaton; made once in each worker. given_names: names known to the hub, any case. endings: what
    surnames end with, ordinary: a bitmap of words that end so and are none; both as names.learn finds them."""

    def __init__(self, given_names: Iterable[str] = (), endings: Iterable[str] = (), ordinary: bytes = b""):
        self.given = frozenset(g.lower() for g in given_names if g) | COMMON_GIVEN
        self.endings, self.ordinary = frozenset(endings), ordinary
        self.sizes = sorted({len(e) for e in self.endings})
        words: dict[str, set[str]] = {}
        for kind, cues in (
            ("at", AT_SIGNS), ("id", ID_CUES), *STREET_CUES.items(), ("given", self.given), ("ending", self.endings), ("title", [f"{t}{e}" for t in TITLES for e in (" ", ". ")]), ("pair", [f"{c} " for c in PAIR_CUES]), ("intro", INTRODUCTIONS)
        ):
            for cue in cues:
                words.setdefault(cue.lower(), set()).add(kind)
        self.auto = ahocorasick.Automaton()
        for cue, kinds in words.items():
            self.auto.add_word(cue, (len(cue), tuple(sorted(kinds))))
        self.auto.make_automaton()

    def spans(self, text: str | None, parts: bool = True) -> list[tuple[int, int, str]]:
        """Disjoint (start, end, kind), in order. Empty for null and empty texts. Without parts, addresses and phone numbers
        are left out."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower()[0] for c in text)
        found: list[tuple[int, int, str]] = []
        names: list[tuple[str, int, int]] = []
        line, floor, read = _Line(text), 0, {}
        for last, (size, kinds) in self.auto.iter(low):
            start, end = last - size + 1, last + 1
            for kind in kinds:
                if kind == "at":
                    if hit := self._email(text, start, end, floor, line):
                        found.append((*hit, "email"))
                    floor = end
                elif kind == "id":
                    if hit := self._identity(text, low, start, end):
                        found.append((*hit, "id_number"))
                elif kind in _STREETS:
                    # A cue that opens an address starts a word, one that closes it ends a word; its line is read once.
                    if start >= read.get(kind, 0) and (low[end - 1] == " " or end == len(low) or not low[end].isalpha()) and (low[end - 1] != " " and low[start:end] != "box" or not start or not low[start - 1].isalpha()):
                        at, to = text.rfind("\n", 0, start) + 1, text.find("\n", end)
                        read[kind] = to = to if to >= 0 else len(text)
                        if parts:
                            found.extend((m.start(), m.end(), "address") for m in _STREETS[kind].finditer(text, at, to))
                elif kind != "ending" or end == len(low) or not low[end].isalpha():
                    names.append((kind, start, end))
        for m in _PHONE.finditer(text) if parts else ():
            if kind := self._number(text, *m.span()):
                found.append((*m.span(), kind))
        if not found and not names:
            return []
        taken = _Taken((s, e) for s, e, _ in found)
        for kind, start, end in names:
            if (hit := getattr(self, f"_{kind}")(text, low, start, end)) and not taken.meets(*hit):
                found.append((*hit, "name"))
        return _disjoint(found)

    # ---- local parsers --------------------------------------------------------------------------------------------
    @staticmethod
    def _email(text: str, start: int, end: int, floor: int, line: _Line) -> tuple[int, int] | None:
        """floor: the end of the at-sign before; no local part reaches beyond it."""
        sign = text[start:end].lower()
        spelt = sign not in ("@", "＠", "%40")
        if sign in ("@", "＠") and text[start - 1 : start] == " " and text[end : end + 1] == " ":  # spaced out
            spelt, end = True, end + 1
            if not _HOST.match(text, end):
                return None
        stop = start
        while spelt and stop > floor and text[stop - 1] == " ":
            stop -= 1
        begin = stop
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < stop and text[begin] in "'.-%":
            begin += 1
        if not any(c.isalnum() for c in text[begin:stop]):
            return None
        h = (_SPELT_AT if sign == " at " else _SPELT_HOST if spelt else _HOST).match(text, end)
        if not h:
            return None
        local = text[begin:stop].lower()
        stop = h.end()
        if not spelt:
            line.upto(begin)
            before = text[max(0, begin - 9) : begin]
            if line.scheme >= 0 and not before.endswith(("mailto:", "mailto://")) or line.shell or before[-1:] == ":" and not before[-2:-1].isalnum():  # userinfo of an address, a remote
                return None
            path = _REMOTE_PATH.match(text, stop)
            if local == "git" or path and (local in ("hg", "svn") or "/" in path[0]) or _PROMPT.match(text, stop) or text[stop : stop + 1] == "@":
                return None
        return begin, stop

    @staticmethod
    def _identity(text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        if start and low[start - 1].isalnum() or end < len(low) and low[end].isalpha():
            return None
        m = _ID_VALUE.match(text, end)
        if not m:
            return None
        value = m[1]
        solid = re.sub(r"[^A-Za-z0-9]", "", value)
        if len(solid) < 7 or len(solid) > 22 or not any(c.isdigit() for c in solid):
            return None
        if solid.isalpha() or (solid.islower() and not solid.isdigit() and len(solid) > 12):
            return None
        return m.start(1), m.end(1)

    @staticmethod
    def _number(text: str, start: int, end: int) -> str | None:
        """phone, id_number or None for a run of digits and separators."""
        raw = text[start:end]
        digits = sum(c.isdigit() for c in raw)
        if _SSN.match(raw):
            return "id_number"
        if raw.count("(") != raw.count(")") or not 7 <= digits <= 16:
            return None
        if raw.lstrip("(").startswith("+"):
            return "phone" if digits >= 8 else None
        if _NANP.match(raw):
            return "phone"
        if raw.startswith("00") and raw[2:3] not in ("", "0") and digits >= 10 and re.search(r"[ (/-]", raw):
            return "phone"
        if _TRUNK.match(raw) and 9 <= digits <= 12:
            return "phone"
        if digits >= 7 and _PHONE_CUE.search(text[max(0, start - PHONE_CUE_REACH) : start]) and not re.match(r"\d{4}-\d\d-\d\d", raw) and not re.match(r"\d+\.\d+\.\d+\.\d+", raw):
            return "phone"
        return None

    def _given(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        """A known given name, with the surname that follows it or stands before it and a comma."""
        size = len(text)
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@/.+-%\\") or end < size and (text[end].isalnum() or text[end] in "_@/\\" or text[end] in ".-" and text[end + 1 : end + 2].isalnum()):
            return None
        word, after = text[start:end], _NEXT.match(text, end)
        cued = self._cued(low, start)
        surname = after[2] if after else ""
        if word[0].islower():
            if surname.islower() and self._ends(surname):
                return start, after.end()
            return (start, end) if low[start:end] not in WORDLIKE and low[start:end] not in COMMON_GIVEN and _STRONG_CUE.search(low[max(0, start - 30) : start]) else None
        follows = bool(surname) and surname[0].isupper() and (word.isupper() or not surname.isupper()) and (self._unknown(surname) or word.isupper() and self._ends(surname))
        begin = start
        if text[start - 2 : start] == ", " and not follows:
            at = _word_before(text, start - 2)
            first = text[at : start - 2]
            if first[:1].isupper() and not first.isupper() and self._unknown(first) and (self._ends(first) or self._cued(low, at) or not at or text[at - 1] in "\n\"'(=,;"):
                begin = at
        if low[start:end] in WORDLIKE:
            if begin < start or follows and (cued or self._ends(surname)):
                return begin, after.end() if follows else end
            return (start, end) if cued and not (surname and (surname[0].isupper() or surname in ("and", "period", "the"))) else None
        return begin, after.end() if follows else end

    def _ending(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        """A word that ends as surnames were seen to, with what stands before it."""
        size = len(text)
        if end < size and (text[end].isalpha() or text[end] in "_@/\\(" or text[end] in ".-" and text[end + 1 : end + 2].isalnum()):
            return None
        begin = _word_before(text, end)
        word = text[begin:end]
        plain = word.rsplit("-", 1)[-1]
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in "_@/.+%\\-") or not (plain.islower() or plain.isupper() or plain[1:].islower()) or not self._ends(plain):
            return None
        at, before = begin, ""
        while at >= 3 and text[at - 1] == " " and text[at - 2] == "." and text[at - 3].isalpha() and not text[at - 4 : at - 3].isalnum():  # initials
            at -= 3
        initial = at < begin
        if at and text[at - 1] == " ":
            before = text[_word_before(text, at - 1) : at - 1]
        known, first = before.lower(), at - 1 - len(before)
        if first and text[first - 1] in "_@/.+%\\-":
            before = ""
        if word[0].islower():
            if not (initial or before and before[0].islower() and (known in self.given or self._cued(low, first) or not first or text[first - 1] in "\n'\"=") and known not in _SENTENCE_WORDS):
                return None
        elif known in LOCATIVES and not initial:
            return None
        if before and known not in _SENTENCE_WORDS and known not in NO_NAMES and (known in self.given or before[0].isupper() and word[0].isupper() and (before[1:].islower() or word.isupper()) or word[0].islower()):
            at = first
        cued, m = self._cued(low, at) and not low.endswith(" and ", 0, at), _COMMA_NAME.match(text, end)
        if m and (m[1].lower() in self.given or m[1][0].isupper() and at == begin and cued and self._unknown(m[1])):
            return at, m.end()
        # Places end as surnames do: a word that nothing beside it tells to be a person's is none.
        return (at, end) if at < begin or cued or "-" in word else None

    def _pair(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        """A phrase that addresses people, and one or two capitalised words nobody knows."""
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@/.-"):
            return None
        m = _CAPITALISED.match(text, end)
        if not m or text[m.end() : m.end() + 1] in ("_", "@", "/", "(", "\\") or re.match(r"[.]\w|['’-]?\d", text[m.end() : m.end() + 2]) or not self._unknown(m[0]):
            return None
        after = _NEXT.match(text, m.end())
        return m.start(), after.end() if after and after[2][0].isupper() and self._unknown(after[2]) else m.end()

    def _intro(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        """A phrase that introduces people or tools, and two capitalised words nobody knows, or an initial and one."""
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@/.-"):
            return None
        m = _TWO.match(text, end)
        if not m:
            return None
        words = re.findall(_CAPITALISED.pattern, m[0])
        return (m.start(1), m.end()) if all(self._unknown(w) or w.lower() in self.given for w in words) else None

    def _title(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        """A title and the capitalised word that follows."""
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@/.-") or not text[start].isupper():
            return None
        m = _TITLED.match(text, end)
        if not m or low[start:end].strip(" .") in ("don", "miss", "sr"):
            return None
        if m[1].lower() in self.given:
            more = _CAPITALISED.match(text, m.end() + 1) if text[m.end() : m.end() + 1] == " " else None
            return start, more.end() if more and self._unknown(more[0]) else m.end()
        # In upper case throughout, MS and DR are none: MS Windows.
        return (start, m.end()) if self._ends(m[1]) or text[start + 1 : end].islower() and self._unknown(m[1]) else None

    def _ends(self, word: str) -> bool:
        """Whether a word ends as surnames were seen to and is no ordinary word that ends so too."""
        w = word.lower()
        if len(w) < LEAST_SURNAME or not any(w[-n:] in self.endings for n in self.sizes) or w in self.given:
            return False
        if self.ordinary:
            bit = zlib.crc32(w.encode("utf-8", "surrogatepass")) % (8 * len(self.ordinary))
            return not self.ordinary[bit >> 3] >> (bit & 7) & 1
        return True

    def _unknown(self, word: str) -> bool:
        """Whether a capitalised word may be a name nobody knows."""
        w = word.lower()
        return w not in NO_NAMES and w not in WORDLIKE and w not in TITLES and w not in _SENTENCE_WORDS and w not in self.given and not word.isupper()

    @staticmethod
    def _cued(low: str, at: int) -> bool:
        """Whether a phrase that introduces a person ends here. No such phrase is longer than 30 characters."""
        return bool(_PERSON_CUE.search(low[max(0, at - 30) : at].rstrip() + " "))


def _word_before(text: str, end: int) -> int:
    """Where the word that ends here starts: letters, with hyphens and apostrophes between them."""
    at = end
    while at and (text[at - 1].isalpha() or text[at - 1] in "-'’" and at < end and text[at - 2 : at - 1].isalpha()):
        at -= 1
    return at


class _Taken:
    """Places that are taken, as disjoint intervals in order."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.ends) and self.starts[i] < end

    def take(self, start: int, end: int) -> None:
        insort(self.starts, start)
        insort(self.ends, end)


_PERSON_CUE = re.compile(
    r"(?:\b(?:pair(?:ing)? with|spoke with|thanks to|according to|written by|opened by|reported by|reviewed by|approved by|signed by|i met|met|and|ask|cc|hi|hello|dear|that|from|by|"
    r"bitte bei|noch auf|lo mandó|lo revisa|contact est|demande à|call|contact|author|owner|attn|mit|von|avec|de|con)\b[:=,]?\s*)$"
)
_SENTENCE_WORDS = frozenset("that the a an and or but with by from to of in on at for if when ask thanks spoke met call dear cc best regards regards hello hi adresse wohnhaft vive".split())


_STRONG_CUE = re.compile(r"(?:\b(?:pair(?:ing)? with|spoke with|thanks to|according to|written by|opened by|reported by|reviewed by|approved by|signed by|i met)[ ]|\b(?:assignee|author|owner|attn)[:=][ ]?['\"]?)$")


def _disjoint(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Longer spans win over those they overlap; touching spans of one kind stay apart."""
    rank = {k: i for i, k in enumerate(KINDS)}
    kept, taken = [], _Taken()
    for s, e, k in sorted(set(found), key=lambda x: (-(x[1] - x[0]), rank[x[2]], x[0])):
        if not taken.meets(s, e):
            taken.take(s, e)
            kept.append((s, e, k))
    return sorted(kept)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by a placeholder of its kind, the rest unchanged."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])
