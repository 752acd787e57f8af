"""Problem 1: credentials embedded in source code: where they start, and the texts without them.

Method: lines that could hold a credential are lexed, and a linear-chain conditional random field labels
each lexical token as part of a credential (S) or not (O) by features of its shape and context; the Viterbi
spans say which literal characters are redacted. The lines come from one pass of a pattern over the whole
text, which only asks for a credential word with a literal near, a long mixed literal, an address with
userinfo or a key's BEGIN line, so the field decides nearly everything. It is trained here, on sentences
composed from templates with random values (training_lines; their number is a parameter), not on the
corpus, whose scan statuses are known to be wrong; the weights are a few thousand numbers in a broadcast.

A value in pieces starts at its first piece: tokens joined by + or line breaks only are one credential. A
private key starts on its BEGIN line and ends with its END line (or the text).

Defined results: null and empty texts hold nothing; lines end with \\n and count from 1; two credentials on
a line are one row of `places`, both are redacted; a redacted value is replaced by REDACTED inside its
quotes, so the code around stays whole; repeated rows repeat in `redacted`, not in `places`; other columns
pass unread.
"""

from __future__ import annotations

import base64
import functools
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How well-known services begin their tokens.
PREFIXES = ("ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "AIza", "sk_live_", "rk_live_", "sk-", "npm_", "pypi-", "SG.", "hf_", "dop_v1_", "shpat_", "eyJ", "ya29.", "whsec_", "key-")
#: Words that announce a credential, and words that say a literal is none.
SAYS = r"passw(?:or)?d|passwd|passphrase|passwort|\bpass\b|\bpw\b|pwd|secret|token|api[_-]?key|credential|auth(?!or)|private[_-]?key|bearer|access[_-]?key|signing[_-]?key|encryption[_-]?key|login|dsn|webhook|\bkey\b"
DENIES = (
    r"public|sha\d*|commit|integrity|checksum|digest|\bhash|etag|uuid|guid|revision|pixel|image|font|wasm|icon|svg|pattern|regex|label|placeholder|mask|example(?!\.)|dummy|fake|sample_|fixture|kind\b|"
    r"fingerprint|version|nonce|\bid\b|record_?id|trace_?id|not_a_secret|do_not_use|\burn\b"
)
SAYING, DENYING = re.compile(SAYS, re.I), re.compile(DENIES, re.I)
VOID = re.compile(r"(?i)x{6,}|\*{3,}|•{3,}|\.{4,}|^<.*>$|\$\{|\{\{|^%\w+%$|^\$[A-Z_]+$|example_|_example|not_a_|do_not|change_?me|replace|your[_-]|placeholder|dummy|^test_|todo|redacted|^data:|^sha\d+-|^(.)\1+$|^0123456|^1234567|abcdefgh")
CANDIDATE = re.compile(
    r"(?:[Pp][Aa][Ss][Ss]|[Pp][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii][Kk_-][Ee_]?|[Cc]red(?:ential)?|CRED|[Aa]uth(?!or)|AUTH|[Bb]earer|BEARER|[Kk]ey|KEY|[Ll]ogin|[Dd]sn|DSN|[Ww]ebhook|WEBHOOK)"
    r"[^\n]*?(?:[\"'`=:(]|\s[^\s]{6})"
    r"|(?<=[\"'`=:\s/])(?=[A-Za-z+/_=-]{0,24}\d)(?=[\d+/_=-]{0,24}[A-Za-z])[A-Za-z0-9+/_=.-]{20,}|://[^\s/:@\"'`]+:[^\s/@\"'`]+@|-----BEGIN|Basic [A-Za-z0-9+/=]{8}|(?:-u|--user) [\w.-]+:[^\s]{4}"
)
LEX = re.compile(
    r"-----BEGIN[^\n\"'`]*|-----END[^\n\"'`]*|\n"
    r"|(?P<q>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
    r"|(?P<c>(?:(?<=-u )|(?<=--user ))[\w.-]+:[^\s\"'`]{4,})"
    r"|(?P<u>[A-Za-z][\w+.-]*://[^\s\"'`<>|)]+)"
    r"|(?P<b>(?<==)[^\s\"'`,;(){}]{5,}|(?<=: )[^\s\"'`{}\[\],;()]{5,}|(?<=\s)(?=\S*\d)(?=\S*[^\W\d_])[^\s\"'`(){}\[\],;:=<>|]{8,})"
    r"|(?P<n>[^\W\d][\w-]*)|(?P<d>\d[\w.]*)|(?P<p>\?\?|\|\||[^\s\w])"
)
#: A bare run of names, as code has them, with a number at most behind each.
NAMES = re.compile(r"!?(?:this\.)?[A-Za-z_$][A-Za-z_$]*\d{0,3}(?:\.[A-Za-z_$][A-Za-z_$]*\d{0,3})*[!?]?")
SLOTS = 15
#: Sentences that the field is trained on, and the most tokens of one.
SENTENCES, LONGEST = 4000, 48


class Token:
    __slots__ = ("at", "end", "kind", "text")

    def __init__(self, text: str, at: int, end: int, kind: str):
        self.text, self.at, self.end, self.kind = text, at, end, kind


def lex(text: str, base: int = 0) -> list[Token]:
    """Lexical tokens; a quoted literal gives one token for each run without spaces."""
    out = []
    for m in LEX.finditer(text):
        kind = m.lastgroup
        at = base + m.start()
        if kind is None:
            out.append(Token(m[0], at, base + m.end(), "line" if m[0] == "\n" else "pem"))
        elif kind == "q":
            inner = m[0][1:-1]
            if "-----BEGIN" in inner:
                out.append(Token(inner, at + 1, at + 1 + len(inner), "pem"))
                continue
            parts = list(re.finditer(r"\S+", inner))
            for k in parts:
                url = "://" in k[0]
                out.append(Token(k[0], at + 1 + k.start(), at + 1 + k.end(), "u" if url else "q" if len(parts) == 1 else "w"))
        else:
            out.append(Token(m[0], at, base + m.end(), "n" if kind == "b" and NAMES.fullmatch(m[0]) and not m[0].startswith(PREFIXES) else "b" if kind == "n" and len(m[0]) >= 16 and m[0].startswith(PREFIXES) else kind))
    return out


def bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


B64 = re.compile(r"[A-Za-z0-9+/]{8,}={0,2}|[A-Za-z0-9_-]{8,}={0,2}")


@functools.lru_cache(maxsize=100_000)
def decoded(token: str) -> str:
    """What kind of text a base64 literal holds: a token of a service, user:password, other text, none."""
    if len(token) % 4 or len(token) < 12 or not B64.fullmatch(token):
        return "none"
    try:
        t = base64.b64decode(token, validate=True).decode("ascii")
    except ValueError:
        return "none"
    if not t.isprintable():
        return "none"
    if t.startswith(PREFIXES) or "://" in t:
        return "service"
    return "userinfo" if re.fullmatch(r"[\w.-]+:\S+", t) else "text"


@functools.lru_cache(maxsize=200_000)
def shape(token: str) -> tuple[str, ...]:
    """The features of a token by itself."""
    n = len(token)
    lower, upper = any(c.islower() for c in token), any(c.isupper() for c in token)
    digits = sum(c.isdigit() for c in token)
    marks = sum(not c.isalnum() and c != "_" for c in token)
    if re.fullmatch(r"[0-9a-f-]+|[0-9A-F-]+", token):
        chars = "hex" if digits and digits < n else "digits" if digits else "hexword"
        if re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token):
            chars = "uuid"
    elif re.fullmatch(r"[a-z]+(?:[./-][a-z]+)*(?:/\d+)?", token):
        chars = "path"
    elif re.fullmatch(r"[A-Za-z_]+", token):
        chars = "word"
    elif re.fullmatch(r"[A-Za-z0-9+/=_-]+", token):
        chars = "b64"
    else:
        chars = "marks"
    classes = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "m" for c in token]
    changes = sum(a != b for a, b in zip(classes, classes[1:])) / max(1, len(classes) - 1)
    url = re.match(r"[A-Za-z][\w+.-]*://([^\s/@]*):([^\s/@]+)@", token)
    info = "no" if not url else "void" if VOID.search(url[2]) or re.search(r"[<{$]", url[1]) else "yes"
    if info == "no" and (q := re.search(r"[?&](?:api_?)?(?:key|token|sig|secret|access_token|password)=([^&\s]{8,})", token, re.I)):
        info = "void" if VOID.search(q[1]) else "query"
    return (
        f"n{bucket(n, (4, 6, 8, 11, 16, 20, 24, 32, 40, 48, 64, 100, 200))}", f"c{chars}{int(lower)}{int(upper)}", f"d{bucket(digits, (1, 2, 4, 8))}", f"m{bucket(marks, (1, 2, 4))}",
        f"x{bucket(changes, (0.08, 0.15, 0.25, 0.4, 0.55))}", f"p{int(token.startswith(PREFIXES) and n >= 16)}", f"v{int(bool(VOID.search(token)))}", f"u{info}", f"b{decoded(token)}",
        f"s{int(bool(SAYING.search(token)))}{int(bool(DENYING.search(token)))}",
    )


@functools.lru_cache(maxsize=100_000)
def word_says(token: str) -> str:
    m = SAYING.search(token)
    return m[0].lower()[:4].replace("-", "_") if m else ""


@functools.lru_cache(maxsize=100_000)
def word_denies(token: str) -> bool:
    return bool(DENYING.search(token))


def features(tokens: list[Token]) -> list[list[str]]:
    """SLOTS categorical features for each token."""
    out = []
    said, said_at, denied_at, before, last_word = "", -99, -99, "", ""
    lines = 0
    for i, t in enumerate(tokens):
        if t.kind == "line":
            lines += 1
            out.append(["line"] + [""] * (SLOTS - 1))
            # a blank line or two lines further, what was said before is forgotten
            if before == "\n":
                said, said_at, denied_at = "", -99, -99
            before = "\n" if before == "\n" or not before else before
            continue
        if t.kind == "pem":
            private = "PRIVATE KEY" in t.text
            out.append([f"pem{int(private)}"] + [""] * (SLOTS - 1))
            before = "-"
            continue
        f = list(shape(t.text))
        gap = i - said_at
        near = bucket(gap, (2, 3, 4, 6, 9, 14))
        weight = "yes" if gap < 14 else "no"
        denied = int(i - denied_at < 7)
        literal = t.kind in ("q", "b", "c", "u", "w")
        f += [
            f"k{t.kind}{before}", f"said{said if weight == 'yes' else ''}{t.kind}", f"near{near}{int(literal)}", f"deny{denied}{int(literal)}{int(weight == 'yes')}",
            f"call{int(literal)}{last_word if last_word in ('Basic', 'Bearer', 'token', 'Buffer', 'login', 'connect', 'env') else ''}",
        ]
        # conjunctions that matter: what is random, said and not denied
        f[9] = f"{f[9]}{int(literal)}{f[1]}"
        f[3] = f"{f[3]}{f[1]}{near < 5}{denied}"
        f[2] = f"{f[2]}{f[0]}{near < 6}"
        out.append(f)
        if t.kind in ("n", "w", "q", "b") and len(t.text) < 60:
            if (s := word_says(t.text)) and (t.kind == "n" or len(t.text) <= 24 and not any(map(str.isdigit, t.text))):
                said, said_at = s, i
            if word_denies(t.text):
                denied_at = i
            last_word = t.text
        before = t.text if t.kind == "p" else "w" if t.kind in ("n", "d") else "l"
    return out


class Field:
    """A linear-chain conditional random field with two labels over hashed categorical features."""

    def __init__(self, weights: dict[str, float] | None = None, moves: np.ndarray | None = None):
        self.weights = weights or {}
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        w = self.weights
        return np.array([w.get("bias", 0.0) + sum(w.get(f"{k}|{v}", 0.0) for k, v in enumerate(r)) for r in rows])

    def spans(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels."""
        m = self.moves
        best, back = [0.0, -1e9], []
        for i, s in enumerate(self.scores(rows).tolist()):
            if i:
                o, c = (best[0] + m[0, 0], best[1] + m[1, 0]), (best[0] + m[0, 1], best[1] + m[1, 1])
                back.append((int(o[1] > o[0]), int(c[1] > c[0])))
                best = [max(o), max(c) + s]
            else:
                best = [0.0, s]
        y = int(best[1] > best[0])
        labels = [y]
        for b in reversed(back):
            y = b[y]
            labels.append(y)
        return labels[::-1]

    @classmethod
    def fit(cls, samples: list[tuple[list[list[str]], list[int]]], rounds: int = 40, penalty: float = 2e-3, rate: float = 0.25) -> Field:
        """Maximum likelihood by Adam on the whole sample, vectorised over sentences of equal padded length."""
        names: dict[str, int] = {"bias": 0}
        longest = max(len(r) for r, _ in samples)
        n = len(samples)
        index = np.zeros((n, longest, SLOTS + 1), np.int32)
        gold, real = np.zeros((n, longest), np.int8), np.zeros((n, longest), bool)
        for i, (rows, labels) in enumerate(samples):
            real[i, : len(rows)], gold[i, : len(rows)] = True, labels
            for t, r in enumerate(rows):
                index[i, t, 1:] = [names.setdefault(f"{k}|{v}", len(names)) for k, v in enumerate(r)]
        w, m = np.zeros(len(names)), np.zeros((2, 2))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
        both = real[:, 1:] & real[:, :-1]
        want = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        for step in range(1, rounds + 1):
            s = np.zeros((n, longest, 2))
            s[:, :, 1] = w[index].sum(2)
            forward = np.zeros_like(s)
            forward[:, 0] = s[:, 0]
            for t in range(1, longest):
                f = np.logaddexp.reduce(forward[:, t - 1, :, None] + m[None], axis=1) + s[:, t]
                forward[:, t] = np.where(real[:, t, None], f, forward[:, t - 1])
            total = np.logaddexp.reduce(forward[:, -1], axis=1)
            backward = np.zeros_like(s)
            for t in range(longest - 2, -1, -1):
                b = np.logaddexp.reduce(m[None] + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(real[:, t + 1, None], b, 0.0)
            p = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * real
            g = np.bincount(index.reshape(-1), weights=np.repeat(((p - gold) * real).reshape(-1), SLOTS + 1), minlength=len(w)) / n + penalty * w / 10
            pair = np.exp(forward[:, :-1, :, None] + m[None, None] + (s + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
            gm = (pair.sum((0, 1)) - want) / n
            for x, grad, a, b in ((w, g, 0, 1), (m, gm, 2, 3)):
                state[a] = 0.9 * state[a] + 0.1 * grad
                state[b] = 0.99 * state[b] + 0.01 * grad**2
                x -= rate * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-8)
        return cls({k: float(w[i]) for k, i in names.items() if abs(w[i]) > 1e-3}, m)


# -- training sentences
LETTERS, HEX, B64S = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
SYLLABLES = "ka lo mi ne pu ra so ti vo ze gra stel brim fond".split()
#: A mark before and behind what is a credential in a training sentence.
ON, OFF = "\x02", "\x03"


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 3)))


def _any(r: random.Random, alphabet: str, a: int, b: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))


def _value(r: random.Random) -> str:
    k = r.randrange(13)
    if k > 10:
        # what people make up: a word or two, a mark, some digits
        a, b, mark, digits = _word(r), _word(r), r.choice("_!#$%&*?@-."), _any(r, string.digits, 2, 4)
        a = a.capitalize() if r.random() < 0.5 else a.replace(r.choice(a), r.choice("013457"), 1) if r.random() < 0.5 else a
        return r.choice([f"{a}{mark}{digits}{b[:3]}", f"{a}_{b}{digits[:2]}{r.choice('!?#$')}", f"{a}{digits}{mark}{b[:3]}", f"{a}{b.capitalize()}{digits}{mark}"])
    if k < 3:
        p = r.choice(PREFIXES[:-1])
        tail = _any(r, string.ascii_uppercase + string.digits, 16, 16) if p in ("AKIA", "ASIA") else _any(r, LETTERS + "_-" * (p == "AIza"), 16, 40)
        if p == "eyJ":
            tail = ".".join(_any(r, LETTERS + "_-", 20, 70) for _ in range(3))
        if p.startswith("xox"):
            tail = f"{_any(r, string.digits, 10, 12)}-{_any(r, LETTERS, 8, 24)}"
        return p + tail
    if k < 5:
        return _any(r, HEX, 32, 32) if r.random() < 0.4 else _any(r, HEX, 40, 40) if r.random() < 0.5 else _any(r, HEX, 64, 64)
    if k < 7:
        return _any(r, B64S, 24, 48)
    if k == 7:
        return _any(r, LETTERS, 14, 34)
    if k == 8:
        return _any(r, LETTERS + "!#$%&*?-@", 12, 22)
    if k == 9:
        w = _word(r)
        w = w.replace(r.choice(w), r.choice("013457"), 1) if r.random() < 0.6 else w.capitalize()
        return f"{w}{r.choice('_%!#$&?-')}{_word(r)}{_any(r, string.digits, 1, 4)}{r.choice(['', '!', '#', '?', '$', 'x'])}"
    return f"{r.choice(['postgres', 'redis', 'mongodb+srv', 'amqp', 'mysql', 'https'])}://{_word(r)}{r.choice(['', '_rw', '-svc'])}:{_any(r, LETTERS, 8, 18)}@{_word(r)}.example:{r.randint(1000, 9999)}/{_word(r)}"


def _known(r: random.Random) -> str:
    """A value that its beginning alone gives away."""
    while not (v := _value(r)).startswith(PREFIXES):
        pass
    return v


def _name(r: random.Random) -> str:
    k = r.choice("apiKey API_KEY authToken accessToken privateToken clientSecret client_secret webhookSecret SESSION_SECRET passwd password dbPassword servicePassword pwd signingKey encryptionKey bearer secretKey secretAccessKey accessKeyId token auth_token jwtSecret DB_PASSWORD smtpPass appSecret".split())
    how = r.randrange(4)
    return k if how == 0 else _word(r) + k[0].upper() + k[1:] if how == 1 else f"{_word(r).upper()}_{k.upper()}" if how == 2 else k + r.choice(["", "_" + _word(r).upper(), _word(r)])


def _positive(r: random.Random) -> str:
    n, v, w, x = _name(r), _value(r), _word(r), _word(r)
    s = f"{ON}{v}{OFF}"
    q = r.choice("\"'")
    b = base64.b64encode(v.encode()).decode()
    h = max(3, len(v) // 2)
    return r.choice([
        lambda: f"const {n} = {q}{s}{q};", lambda: f"const {n} = process.env.{n.upper()} ?? {q}{s}{q};", lambda: f"export const {n}: string = {q}{s}{q}",
        lambda: f"  {n}: {q}{s}{q},", lambda: f'  "{n}": "{s}"', lambda: f"{n.upper()}={s}", lambda: f"#{n.upper()}={s}", lambda: f"export {n.upper()}='{s}'",
        lambda: f"/* {n} = {s} ({w}, rotate later) */", lambda: f"// {n}: {s}", lambda: f"// {w} login for {x}: {w}-ops with {r.choice(['pw', 'pass', 'password'])} {s}",
        lambda: f"// the {r.choice(['password', 'token', 'secret'])} for {w} is {s}", lambda: f"// {r.choice(['old', 'test', 'staging'])} login for {x}: {w}-ops / {r.choice(['password', 'pass', 'pw'])} {s}", lambda: f"  - name: {n.upper()}\n    value: {s}\n  {w}: {x}", lambda: f"- name: {n.upper()}\n  value: {s}", lambda: f"  {n}: {s}", lambda: f"{n} = {q}{s}{q}",
        lambda: f'headers: {{ Authorization: "{r.choice(["Bearer", "token"])} {s}" }},', lambda: f'{w}("Bearer {s}");', lambda: f'headers = {{"X-Auth": "{s}"}}  # {w}',
        lambda: f'headers.set("Authorization", "Basic {ON}{base64.b64encode(f"{w}:{v[:20]}".encode()).decode()}{OFF}");', lambda: f'await {w}Client.login("{x}-svc", "{s}");',
        lambda: f'client = connect("{w}.example", {n}={q}{s}{q})', lambda: f'const {n} = Buffer.from("{ON}{b}{OFF}", "base64").toString();', lambda: f'const {n} = atob("{ON}{b}{OFF}");',
        lambda: f'const {w} = {{ region: "{x}", "{n}": {q}{s}{q}, ttl: {r.randint(1, 999)} }};', lambda: f'const {n} =\n  "{ON}{v[:h]}{OFF}" +\n  "{ON}{v[h:]}{OFF}";',
        lambda: f'const {n} = ["{ON}{v[:h]}{OFF}", "{ON}{v[h:]}{OFF}"].join("");', lambda: f"| {n} | `{s}` |", lambda: f"Run it with `{w} --{n} {s}` once.", lambda: f"//registry.{w}.example/:_authToken={s}",
        lambda: f"const {w}Endpoint = `https://{x}.example/v1/{w}?key={s}&size=${{{r.randint(1, 99)}}}`;" if "://" not in v else f"const {w}Url = {q}{s}{q};",
        lambda: f'const {w} = "{ON}{r.choice(PREFIXES[:4])}{_any(r, LETTERS, 30, 40)}{OFF}";', lambda: f'const {w} = connect("{ON}postgres://{w}:{_any(r, LETTERS, 9, 14)}@{x}.example/{w}{OFF}");',
        lambda: f'curl -H "Authorization: Bearer {s}" https://{w}.example', lambda: f'{x}.setPassword("{s}");', lambda: f"if ({n} === {q}{s}{q}) {{",
        lambda: f"curl -u {w}:{s} https://{x}.example/{w}", lambda: f"    curl --user {w}:{s} https://{x}.example", lambda: f"curl -u {w}:{s} https://{w}.example", lambda: f'headers = {{"X-Auth": "{s}"}}  # {w}', lambda: f'headers = {{"X-Api-Key": {q}{s}{q}, "{w}": "{x}"}}', lambda: f'  "x-auth-token": "{s}",', lambda: f"Run it with `{w} --{n} {s}` once, then {x}.",
        lambda: f"const {w} = {q}{ON}{_known(r)}{OFF}{q};", lambda: f"  {w}: [{q}{ON}{_known(r)}{OFF}{q}],", lambda: f"// {w} {x} {ON}{_known(r)}{OFF}", lambda: f'!function(e,t,n,o){{var {x}={{{w}:{r.randint(1, 999)}}};e.{w}="{ON}{_known(r)}{OFF}";t.{x}(e)}}', lambda: f'e.{w}.{n}="{s}",t[{r.randint(1, 99)}]=n',
        lambda: f"{w}({q}{ON}{_known(r)}{OFF}{q}, {{ {x}: {r.randint(1, 99)} }});", lambda: f"/* {n} = {s} ({w}, rotate later) */",
    ])()


def _negative(r: random.Random) -> str:
    n, w, x = _name(r), _word(r), _word(r)
    q = r.choice("\"'")
    label = f"{w}.{x}/{r.randint(1, 99)}"
    hexes = _any(r, HEX, 40, 40) if r.random() < 0.5 else _any(r, HEX, 64, 64)
    return r.choice([
        lambda: f"const {n} = process.env.{n.upper()};", lambda: f'const {n} = "${{{n.upper()}}}";', lambda: f"const {n} = {q}<your-{n}>{q};", lambda: f'const {w}AccessKeyId = "AKIA{"X" * 16}"; // replace me',
        lambda: f"// {n}=EXAMPLE_NOT_A_SECRET", lambda: f'export const {w}TEST_TOKEN_DO_NOT_USE = "TEST_TOKEN_DO_NOT_USE";', lambda: f'const {w}PasswordLabel = "Enter your password";',
        lambda: f'const {w}Mask = "{r.choice(["sk_live_", "ghp_", ""])}{"*" * r.randint(6, 30)}";', lambda: f"const {w}PasswordPattern = /^(?=.*[A-Z])(?=.*\\d)[A-Za-z\\d!#%]{{12,}}$/;",
        lambda: f"const {w}Url = `postgres://${{user}}:${{password}}@{x}.example:5432/{w}`;", lambda: f'const {w}Credentials = loadCredentials("{w}/{x}", {{ password: promptUser() }});',
        lambda: f'const {w}TokenKind = "{r.choice(["bearer", "refresh", "access"])}";', lambda: f'export const {w}CommitSha = "{hexes}";', lambda: f'const {w}Checksum = "{hexes}";', lambda: f'"commit": "{hexes}",',
        lambda: f'const {w}Integrity = "sha512-{_any(r, B64S, 86, 86)}==";', lambda: f'  "integrity": "sha512-{_any(r, B64S, 86, 86)}=="', lambda: f'const {w}Pixel = "data:image/png;base64,{_any(r, B64S, 40, 120)}";',
        lambda: f'const {w}Id = "{_any(r, HEX, 8, 8)}-{_any(r, HEX, 4, 4)}-{_any(r, HEX, 4, 4)}-{_any(r, HEX, 4, 4)}-{_any(r, HEX, 12, 12)}";', lambda: f'  "{_any(r, B64S, 60, 76)}" +', lambda: f'export const {w}Wasm =\n  "{_any(r, B64S, 70, 76)}" +',
        lambda: f'export const {w}Font = "data:font/woff2;base64,{_any(r, B64S, 90, 150)}";', lambda: f'const {w}Token = {x}.next("{label}");', lambda: f"  {n}: {w}.{x},", lambda: f'throw new Error("invalid {r.choice(["token", "password", "secret"])} for {label}");',
        lambda: f'const {w} = {x}.{w} ?? "{label}";', lambda: f'  case "{w} {x} {w}":', lambda: f"private readonly {n}: string;", lambda: f"function check{w.capitalize()}({n}: string, {w} = {r.randint(1, 999)}) {{", lambda: f"return <li key={{row.{w}}}>{{row.{x}}}</li>;",
        lambda: f'  "version": "{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",', lambda: f'import {{ {w}Token, {x}{r.randint(10, 99)} }} from "@{w}/{x}-{w}";', lambda: f"const {w}{r.randint(10, 99)} = await {x}.login({w});", lambda: f'{n} = os.environ["{n.upper()}"]',
        lambda: f"{w.upper()}_{x.upper()}={r.choice(['on', 'off', x, str(r.randint(1, 9999))])}", lambda: f"{n.upper()}=${{{n.upper()}}}", lambda: f"  {n}: ${{{n.upper()}}}", lambda: f'  {n}: "{r.choice(["changeme", "xxxxxxxx", "your-secret-here", "placeholder", "test", "dummy-token"])}",',
        lambda: f'const publicKey = "{_any(r, B64S, 40, 90)}";', lambda: f'// {n} must be at least {r.randint(8, 30)} characters, see {w}/{x}{r.randint(1, 30)}.md', lambda: f'const {n} = getSecret("{w}/{x}");', lambda: f'it("rejects a {r.choice(["token", "password"])} of {w}", () => {{',
        lambda: f'  {{ {w}: {r.randint(1, 99999)}, {x}: "{_any(r, HEX, 6, 6)}" }},', lambda: f'  "resolved": "https://registry.example/{w}/-/{w}-{r.randint(1, 9)}.{r.randint(1, 9)}.0.tgz",', lambda: f'const {w}Etag = "{_any(r, HEX, 32, 32)}";', lambda: f'"{n}": "{w}.{x}",',
        lambda: f"export const {w}{r.choice(['Wasm', 'Data', 'Blob', ''])} =\n" + "\n".join(f'  "{_any(r, B64S, 60, 76)}" +' for _ in range(r.randint(3, 7))), lambda: "\n".join(f'  "{_any(r, B64S, 60, 80)}" +' for _ in range(r.randint(2, 6))) + f'\n  "{_any(r, B64S, 8, 50)}";',
        lambda: f"const {w}Key = `-----BEGIN PUBLIC KEY-----\n{_any(r, B64S, 64, 64)}\n{_any(r, B64S, 64, 64)}\n-----END PUBLIC KEY-----`;", lambda: "\n".join(_any(r, B64S, 64, 64) for _ in range(r.randint(1, 4))),
        lambda: f"const {w}Key = `-----BEGIN EC PRIVATE KEY-----\n{_any(r, B64S, 64, 64)}\n{_any(r, B64S, 64, 64)}\n-----END EC PRIVATE KEY-----`;",
        lambda: f"{w}{x.capitalize()}{r.randint(1, 99)}.{x}({{ {w}: {x}{r.randint(1, 99)}, {x}: true }});", lambda: f"const {{ {w}{r.randint(1, 99)}, {x} }} = {x}{r.randint(1, 99)}.{w}.map((it) => it.{x} * {r.randint(1, 999)});",
        lambda: f"!function(e,t,n,o){{var {_any(r, LETTERS[:52], 1, 2)}={{{w}:{r.randint(1, 999)},{x}:!0,{w}:\"{x}\"}},x{r.randint(1, 9)}=t.{w};e.{x}=function(s){{return s?s.{w}:void {r.randint(1, 9)}}}}}", lambda: f"export interface {w.capitalize()}{x.capitalize()}{r.randint(1, 99)}Message {{",
        lambda: f"  static readonly {w.upper()}_{x.upper()} = new {w.capitalize()}({r.randint(1, 99)}, \"{label}\", {r.randint(1, 99999)}, {x});", lambda: f'{w}Token{r.randint(1, 99)}.{x}("{label}", {r.randint(1, 99)});', lambda: f'sync {w}-{r.randint(1, 99)}a: the key keeps one {x} per {w}.',
        lambda: f"const {w}Key = `${{{x}.{w}}}-{w} {x} {w}-${{{x}{r.randint(1, 99)}}}`;", lambda: f"throw new Error(`unknown {x} ${{this.{w}Key}}`);", lambda: f"const {w} = `${{{x}Key.{w}}}-{label}-${{{w}}}`;",
        lambda: '  "source": "import type { %sKey, %s } from \\"./%s-%s\\";\\n\\nfunction %sToken(%s: Record<string, unknown>) {\\n  const %s = %s.%s({ %s: %d });",' % (w, x, w, x, w, x, w, x, w, x, r.randint(1, 999)),
        lambda: f"curl -u {w}:${{{n.upper()}}} https://{x}.example", lambda: f"docker run -u {r.randint(1, 2000)}:{r.randint(1000, 2000)} {w}", lambda: f"curl -u {w}:<{n}> https://{x}.example/{w}",
        lambda: f"uses: {w}/{x}@{hexes[:40]}", lambda: f"image: {w}.example/{x}@sha256:{_any(r, HEX, 64, 64)}", lambda: f'const {w}Key = "{w}.{x}.{w}";', lambda: f"  key: {w}-{x}", lambda: f'<li key="{w}-{r.randint(1, 999)}">', lambda: f'const {w}Path = "M{r.randint(1, 99)}.{r.randint(1, 9)} {r.randint(1, 99)}.0L {r.randint(1, 99)}.4 {r.randint(1, 99)}.2Z";',
    ])()


def training_lines(sentences: int = SENTENCES, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    r = random.Random(seed)
    out = []
    for _ in range(sentences):
        parts = [_positive(r) if r.random() < 0.45 else _negative(r)]
        if r.random() < 0.5:
            parts.insert(0, _negative(r))
        if r.random() < 0.4:
            parts.append(_negative(r))
        marked = "\n".join(parts)
        text, spans, at = "", [], 0
        for piece in re.split(f"({ON}|{OFF})", marked):
            if piece == ON:
                at = len(text)
            elif piece == OFF:
                spans.append((at, len(text)))
            else:
                text += piece
        tokens = lex(text)[:LONGEST]
        labels = [int(t.kind not in ("p", "line") and any(t.at < e and t.end > s for s, e in spans)) for t in tokens]
        if tokens:
            out.append((features(tokens), labels))
    return out


@functools.lru_cache(maxsize=2)
def trained(sentences: int = SENTENCES, seed: int = 7) -> Field:
    return Field.fit(training_lines(sentences, seed))


# -- finding
END = re.compile(r"-----END[^\n\"'`]*PRIVATE KEY[^\n\"'`-]*-----")
SPLIT_PEM = re.compile(r"-----BEGIN\s*[\"'`+,\s\\n]{0,40}(?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED|PGP)[\"'`+,\s]{0,40})?PRIVATE[\"'`+,\s]{0,40}KEY")
#: What of a key may follow its BEGIN line where no END line does: long runs of its characters and what joins them.
KEY_MATERIAL = re.compile(r"(?:\\[nr]|[\s\"'`+,.()\[\]\\-]|(?:Proc-Type|DEK-Info)[^\n]*|[A-Za-z0-9+/=]{8,})*")
PLAIN_GAP = re.compile(r"[\s\"'`+,.\\()\[\]]*(?:\.concat\()?[\s\"'`+,]*")


def regions(text: str) -> list[tuple[int, int]]:
    """Character ranges of the lines that may hold a credential, with two lines before and one behind."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := CANDIDATE.search(text, at):
        a = text.rfind("\n", 0, m.start())
        for _ in range(2):
            a = text.rfind("\n", 0, a) if a > 0 else -1
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        c = text.find("\n", b + 1)
        c = len(text) if c < 0 else c
        if out and a + 1 <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], c))
        else:
            out.append((a + 1, c))
        at = b + 1
        if at >= len(text):
            break
    return out


def credentials(text: str | None, field: Field) -> list[tuple[int, int]]:
    """Character spans of the credentials' literals, in order; pieces of one credential follow each other."""
    if not text:
        return []
    found: list[tuple[int, int]] = []
    for a, b in regions(text):
        part = text[a:b]
        tokens = lex(part, a)
        if not tokens:
            continue
        rows = features(tokens)
        labels = field.spans(rows) if any(t.kind in ("q", "b", "c", "u", "w", "n", "pem") for t in tokens) else []
        found += [(t.at, t.end) for t, y in zip(tokens, labels) if y and t.kind in ("q", "b", "c", "u", "w", "n", "d")]
    for m in re.finditer(SPLIT_PEM, text):
        e = END.search(text, m.end())
        body = text[m.end() : e.start()] if e else KEY_MATERIAL.match(text, m.end())[0]
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40 and not re.search(r"\.\.\.|…|<[^>]+>|x{8}", body):
            found.append((m.start(), e.end() if e else len(text)))
    found.sort()
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def starts(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """The lines, from 1, on which a credential starts."""
    out = []
    for k, (s, _) in enumerate(spans):
        if k and PLAIN_GAP.fullmatch(text, spans[k - 1][1], s) and "+" in text[spans[k - 1][1] : s] or k and re.fullmatch(r"[\"'`]\s*,\s*[\"'`]", text[spans[k - 1][1] : s]):
            continue
        out.append(text.count("\n", 0, s) + 1)
    return sorted(set(out))


def _shared(spark: SparkSession, sentences: int):
    f = trained(sentences)
    return spark.sparkContext.broadcast((f.weights, f.moves))


def places(spark: SparkSession, documents: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """doc_id, line_no: the lines on which a credential starts."""
    shared = _shared(spark, sentences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            rows = [(i.as_py(), n) for i, t in zip(batch.column(0), batch.column(1)) if t.is_valid for n in starts(t.as_py(), credentials(t.as_py(), field))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], names=["doc_id", "line_no"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, line_no bigint").distinct()


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        # line breaks inside a value stay, so every line keeps its number
        out += [text[at:s], "REDACTED" + "\n" * text.count("\n", s, e)]
        at = e
    return "".join(out) + text[at:]


def redacted(spark: SparkSession, documents: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """doc_id, secret_scan_status (clean or rejected), text with the credentials' characters replaced."""
    shared = _shared(spark, sentences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                spans = [credentials(t, field) for t in texts]
                status = pa.array(["rejected" if s else "clean" for s in spans], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), status, pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string())], names=["doc_id", "secret_scan_status", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, secret_scan_status string, text string")


def status_changes(found: DataFrame, documents: DataFrame, records: DataFrame) -> DataFrame:
    """secret_scan_status of the earlier scan, against what was found: how many documents."""
    earlier = records.select("record_id", "secret_scan_status").where("record_id is not null").groupBy("record_id").agg(F.max("secret_scan_status").alias("earlier"))
    rows = documents.select("doc_id", "record_id").join(found.select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left").join(earlier, "record_id", "left")
    return rows.groupBy("earlier", F.when(F.col("hit") == 1, "rejected").otherwise("clean").alias("now")).agg(F.count("*").alias("documents"))
