"""Credentials in code, configuration, commands and prose.

An automaton over cue words leaves out the many texts without any. In the rest, keypaths reads configuration formats
into (key path, value, offsets): a value counts if a part of its path is sensitive (its key, the name beside it, the key
above a mere "value", a group of secrets above) and its shape is that of a literal. Patterns read what is no format: single
assignments within code, addresses, headers, options, commands and prose. Tokens of known issue and private key blocks
count wherever they stand. Spans cover the value only, so that splicing a placeholder in leaves quotes, keys and the
code around as they were. No pattern reads a stretch from more than one place, so the cost is linear in the length.

Offsets count code points in text and bytes in redact_bytes, which splices into the original bytes.
"""

from __future__ import annotations

import re

import ahocorasick

from tidemark.llm import keypaths

# ---- fixed values ---------------------------------------------------------------------------------------------------
CUES = (
    "pass", "pwd", "pw", "kennwort", "contraseña", "clave", "secret", "token", "key", "auth", "bearer", "basic ", "-----begin", "://", "credential", "login",
    "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "akia", "asia", "agpa", "aida", "aiza", "eyj", "nvapi-", "_live_", "_test_", " -p", " -a ", " -u", "--user", " -k ", "pin ",
)
KNOWN_TOKENS = (
    r"sk-ant-[A-Za-z0-9_-]{16,}", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}", r"nvapi-[A-Za-z0-9_-]{16,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"glpat-[A-Za-z0-9_-]{16,}",
    r"(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{16}(?![A-Z0-9])", r"AIza[A-Za-z0-9_-]{30,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"[a-z]{2,10}_(?:live|test)_[A-Za-z0-9]{16,}",
)
# Six-letter parts of ordinary identifiers, as in api_client: not the random half of a pass phrase.
CODE_WORDS = frozenset("client secret tokens string header config server method object parser reader writer holder loader folder length number format prefix suffix handle helper source target".split())
_SENSITIVE = r"pass(?:word|wd|phrase|code)?s?|pwd|pw|passwort|kennwort|secret|token|api[_-]?key|access[_-]?key|shared[_-]?key|private[_-]?key|signing[_-]?key|secret[_-]?key|encryption[_-]?key|auth[_-]?token|authtoken|auth|credentials?|contraseña"
# Groups whose every member is a secret, and keys whose value is one even if it is a plain word.
_GROUP = re.compile(r"(?:[a-z0-9]+[_.-])*(?:secrets|credentials|creds|passwords|passphrases|api[_-]?keys|auth[_-]?tokens|access[_-]?tokens)", re.I)
_PLAIN_KEY = re.compile(r"(?:[\w.-]*[_.-])?(?:pass(?:word|wd|phrase)?|pwd|passwort|kennwort|secret|contraseña)|\w*(?:Password|Passphrase)", re.I)
# Plain words after such a key that say something about it.
NO_SECRETS = frozenset("required optional missing invalid empty unset unchanged changed expired wrong correct string text none null true false yes no default hidden prompt input file env vault stdin here same unknown rotated stored encrypted hashed plain value field enabled disabled".split())
LEAST_SECRET = 3  # characters; what is shorter cannot be told from a flag

_KNOWN = re.compile(r"(?<![A-Za-z0-9_/+-])(?:" + "|".join(KNOWN_TOKENS) + ")")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEYED = rf"(?:(?<![A-Za-z0-9])(?:{_SENSITIVE})|Password|Passwd|Token|Secret|ApiKey|SharedKey|PrivateKey|AccessKey|(?<=[A-Za-z0-9]_)(?:KEY|PASS|PW))"
# key = value, key: value, "key": "value", --set a.key=value, ?key=value, Key=value; and os.environ["KEY"] = 'value'
_ASSIGN = re.compile(rf"(?P<k>{_KEYED})[\"']?\]?\s*(?::|=>|:=|=)\s*(?P<v>[bru]?\"(?:[^\"\\\n]|\\.)*\"|[bru]?'(?:[^'\\\n]|\\.)*'|[\"']?[^\s,;&|\"'<>]+)", re.I)
_JOINED = re.compile(rf"(?<![A-Za-z0-9])(?P<k>{_SENSITIVE}|key)\s*[:=]\s*(?P<v>\"[^\"\n]*\"(?:\s*\+\s*\"[^\"\n]*\")+)", re.I)
_URL = re.compile(r"(?<=[a-z0-9+.-])://[^\s:/@\"']*:(?P<v>[^\s@/\"']+)@", re.I)
_HEADER = re.compile(r"\b(?:bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/_.=~-]{12,})", re.I)
_XHEADER = re.compile(r"(?<![A-Za-z-])X-[A-Za-z-]*(?:Key|Token|Secret|Auth)\s*:\s*(?P<v>\S+)", re.I)
_NETRC = re.compile(r"\b(?:login|user)\s+\S+\s+password\s+(?P<v>\S+)", re.I)
_CALL = re.compile(r"\b\w*(?:password|passwd|secret|token|apikey)\(\s*(?P<v>\"[^\"\n]+\"|'[^'\n]+')\s*\)", re.I)
_OPTION = re.compile(r"(?<![A-Za-z-])--(?:[a-z-]*-)?(?:password|passphrase|token|secret|api-key|apikey|auth-token|access-key|key|pass)(?:\s+|=)(?P<v>\"[^\"]+\"|'[^']+'|[^\s|;&]+)", re.I)
_SET = re.compile(r"(?:_authToken|secret_access_key|access_key_id|password|token)\s+(?P<v>[A-Za-z0-9+/_=-]{16,})(?=\s|$|[\"'])", re.I)
# The command, what else stands in its part of the line, and the option with the secret.
_ARGUMENT = r"(?P<v>'[^']+'|\"[^\"]+\"|[^\s'\"|;&]+)"
_COMMANDS = tuple(
    (re.compile(rf"\b(?:{command})\b"), re.compile(option))
    for command, option in (
        ("sshpass", rf"\s-p\s*{_ARGUMENT}"),
        ("mysql|mysqldump|mysqladmin|mariadb", rf"\s-p{_ARGUMENT}"),
        ("redis-cli", rf"\s-a\s+{_ARGUMENT}"),
        ("openssl", rf"\s-(?:k|K|pass|passin|passout)\s+(?:pass:)?{_ARGUMENT}"),
        ("curl|wget|http", r"\s(?:-u|--user)[ =]?['\"]?[\w.@-]+:(?P<v>[^\s'\"|;&]+)"),
        (r"(?:docker|podman|helm)\s(?=[^\n|;]*\blogin)", rf"\s-p\s+{_ARGUMENT}"),
    )
)
_PART = re.compile(r"[^\n|;]+")
_ECHO = re.compile(r"\becho\s+(?:-n\s+)?(?P<v>'[^']+'|\"[^\"]+\"|[^\s'\"|;&$]+)\s*\|")
_STDIN = re.compile(r"--(?:password|token|with)")
_PROSE = re.compile(
    r"\b(?:(?:password|passwort|kennwort|passphrase|mot de passe|contraseña|clave|pw)\b(?:[ ](?!is\b|lautet\b|was\b)[^\s:=,;\"'`]*[^\s:=.,;\"'`]){0,7}?|(?:secret|pass|passcode|token|api key))(?:[ ](?:is|lautet|ist|est|es|was|war)|\s?[:=])\s+(?:\d{4}\s*/\s*)?[\"'`]?(?P<v>[^\s\"'`<>]+)", re.I
)
_BLANK = re.compile(r"(?:\\n|\s)+")
_TRAILING = re.compile(r"(?:\\n|\s)+$")
_COMMAND = re.compile("|".join(command.pattern for command, _ in _COMMANDS))
_REFERENCE = re.compile(
    r"^(?:\$|%\w+%$|\{\{|<|\[|\*+|x{4,}$|\.{3,}|…|-+$|#$|@[\w./-]+/|env[.:(]|os\.|process\.|vault[:/(]|secret[:/(]|file:|ref:|!(?:vault|secret|ref|sub|env)\b|arn:|projects/|ssm:|keyring|null$|none$|nil$|true$|false$|undefined$|str\b|string\b|bytes\b|int\b|bool\b|optional\b|any\b|"
    r"your[-_ ]|my[-_]?(?:pass|secret|token|key)|change[-_]?me|placeholder|example|redacted|masked|hidden|todo|dummy|sample|\(|/run/|/etc/|~/|\./)|^[\w.]+\(|^[\w.]+\[|redacted|your-|\*{3,}|\$\{|\$\(",
    re.I,
)

_SENSITIVE_KEY = re.compile(rf"(?:[^\s=]*[_.\-/:\[\]])?(?:{_SENSITIVE})|[A-Za-z0-9_.-]*(?:Password|Passwd|Token|Secret|ApiKey|SharedKey|PrivateKey|AccessKey)|(?:[A-Z0-9]+_)+(?:KEY|PASS|PW)", re.I)
_KEY_CUES = frozenset(("pass", "pwd", "pw", "kennwort", "contraseña", "secret", "token", "key", "auth", "credential"))
_COMMAND_CUES = frozenset((" -p", " -a ", " -u", "--user", " -k ", "pass", "key"))


def _sensitive(path: tuple[str, ...], named: bool) -> bool:
    """Whether the key that says what the value is, is a sensitive one, or a group above holds secrets only."""
    key = path[-2] if len(path) > 1 and not named and path[-1].lower() in keypaths.VALUES else path[-1]
    return _SENSITIVE_KEY.fullmatch(key) is not None or any(_GROUP.fullmatch(k) for k in path)


class Finder:
    """Finds literal secrets; made once in each worker."""

    def __init__(self) -> None:
        self.auto = ahocorasick.Automaton()
        for cue in CUES:
            self.auto.add_word(cue, cue)
        self.auto.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Disjoint (start, end) of secret values in order. Empty for null and empty texts."""
        if not text:
            return []
        cues = {cue for _, cue in self.auto.iter(text.lower())}
        if not cues:
            return []
        found: list[tuple[int, int]] = []
        add = lambda m, g="v", strict=False, bare=False: self._value(text, *m.span(g), found, strict, bare)
        found += [m.span() for m in _KNOWN.finditer(text) if not _REFERENCE.search(m[0])]
        if "-----begin" in cues:
            at = 0
            while m := _PEM.search(text, at):
                stop = text.find("-----END", m.end())
                at = stop = len(text) if stop < 0 else stop
                body = text[m.end() : stop]
                start = m.end() + len(body) - len(_BLANK.sub("", body, count=1)) if _BLANK.match(body) else m.end()
                body = text[start:stop]
                tail = _TRAILING.search(body[-400:])
                end = stop - (len(tail[0]) if tail else 0)
                if len(re.sub(r"\\n|\s", "", body)) >= 16 and not _REFERENCE.match(text[start:end]):
                    found.append((start, end))
        for m in _ASSIGN.finditer(text):
            key = m["k"].lower()
            if key.endswith(("auth",)) and not re.search(r"[\"']", m["v"][:1]):
                continue
            add(m, strict=not m["v"].lstrip("bru")[:1] in "\"'")
        for m in _JOINED.finditer(text):
            whole = "".join(re.findall(r"\"([^\"]*)\"", m["v"]))
            if (len(whole) >= 12 and re.search(r"\d", whole) or _KNOWN.fullmatch(whole)) and not _REFERENCE.search(whole):
                found += [(m.start("v") + q.start(1), m.start("v") + q.end(1)) for q in re.finditer(r"\"([^\"]*)\"", m["v"]) if q[1]]
        if "://" in cues:
            for m in _URL.finditer(text):
                add(m, bare=True)
        for pattern in (_HEADER, _XHEADER, _NETRC, _OPTION, _SET):
            for m in pattern.finditer(text):
                add(m, strict=True)
        for m in _CALL.finditer(text):
            add(m)
        if not _COMMAND_CUES.isdisjoint(cues):
            for part in _PART.finditer(text) if _COMMAND.search(text) else ():
                for command, option in _COMMANDS:
                    if c := command.search(text, *part.span()):
                        for m in option.finditer(text, c.end() - c[0][-1].isspace(), part.end()):
                            add(m, bare=True)
            if "echo" in text and _STDIN.search(text):
                for line in keypaths.LINE.finditer(text):
                    for read in list(_STDIN.finditer(text, *line.span()))[-1:]:
                        for m in _ECHO.finditer(text, line.start(), read.start()):
                            add(m, strict=True, bare=True)
        for m in _PROSE.finditer(text):
            add(m, strict=True)
        if not _KEY_CUES.isdisjoint(cues):
            for p in keypaths.pairs(text):
                if _sensitive(p.path, p.named):
                    quoted = text[p.start] in "\"'"
                    if quoted or not any(" " in x.strip() or "\t" in x.strip() for x in text[p.start : p.end].splitlines()):
                        self._value(text, p.start, p.end, found, not quoted, False, p.line and _PLAIN_KEY.fullmatch(p.path[-1]) is not None)
        return _merged(found)

    @staticmethod
    def _value(text: str, start: int, end: int, found: list[tuple[int, int]], strict: bool, bare: bool, plain: bool = False) -> None:
        """Adds the literal within text[start:end], without its quotes, if its shape is that of a secret. plain: the key
        and the form are such that a plain word is one too."""
        raw = text[start:end]
        while raw[:1] in "bru" and raw[1:2] in ("'", '"'):
            start, raw = start + 1, raw[1:]
        if raw[:1] in ("'", '"'):
            start, raw = start + 1, raw[1:]
            if raw[-1:] in ("'", '"'):
                end, raw = end - 1, raw[:-1]
        elif not bare:
            cut = raw.rstrip(".,;:)]}\"'")
            end, raw = end - (len(raw) - len(cut)), cut
        if len(raw) < LEAST_SECRET or _REFERENCE.search(raw) or re.search(r"@[\w-]+(?:\.[\w-]+)+(?:[:/]|$)", raw):
            return
        if plain and raw.isalpha():
            if raw.lower() in NO_SECRETS:
                return
        elif strict:
            kinds = sum(bool(re.search(p, raw)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]|_"))
            if kinds < 2 or not re.search(r"\d|[^\w\s'’.-]|_", raw) and not re.search(r"[a-z][A-Z]|[A-Z]{2,}[a-z]", raw) or raw.isdigit():
                return
            if re.fullmatch(r"[\w.-]+/[\w./-]+", raw) and not re.search(r"\d", raw) or re.fullmatch(r"[a-z_]+", raw) or re.fullmatch(r"[A-Z_]+", raw):
                if not re.fullmatch(r"[a-z]+_[a-z0-9]{5,}", raw):
                    return
            if re.fullmatch(r"[a-z]+(?:[._][a-z]+)+\d?", raw) and not (re.fullmatch(r"[a-z]+_[a-z0-9]{6}", raw) and raw.split("_")[1] not in CODE_WORDS):
                return
        found.append((start, end))


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(found)):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with each secret value replaced by [SECRET], everything else byte for byte as it was."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


def redact_bytes(data: bytes | None, finder: Finder) -> bytes | None:
    """The bytes with each secret value replaced, every other byte as it was, also such that are no UTF-8."""
    if data is None:
        return None
    text = data.decode("utf-8", "surrogateescape")
    out, at, byte = [], 0, 0
    for s, e in finder.spans(text):
        start = byte + len(text[at:s].encode("utf-8", "surrogateescape"))
        out += [data[byte:start], b"[SECRET]"]
        at, byte = e, start + len(text[s:e].encode("utf-8", "surrogateescape"))
    return b"".join([*out, data[byte:]])
