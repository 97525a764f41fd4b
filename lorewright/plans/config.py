"""Configuration: YAML, environment overrides, validation."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

DEFAULT_PORT = 8000
DEFAULT_DIMENSIONS = 1024


class ConfigError(ValueError):
    pass


class YamlError(ConfigError):
    pass


BLOCK = re.compile(r"([|>])([+-]?)(\d?)([+-]?)\Z")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _plain(s: str):
    """The value of an unquoted scalar."""
    s = s.strip()
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    for kind in (int, float):
        try:
            return kind(s) if not s.startswith("_") and "_" not in s else s
        except ValueError:
            pass
    return s


def _unquoted(s: str) -> str:
    """The text of a quoted scalar."""
    if s[0] == "'":
        return s[1:-1].replace("''", "'")
    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)


def _without_comment(s: str) -> str:
    """A line up to a comment, which begins at # at its start or behind white space, outside quotes."""
    quote = ""
    for i, c in enumerate(s):
        if quote:
            if c == quote and (quote == "'" or s[i - 1] != "\\"):
                quote = ""
        elif c in "\"'" and (i == 0 or s[i - 1] in " [{,:\t"):
            quote = c
        elif c == "#" and (i == 0 or s[i - 1] in " \t"):
            return s[:i].rstrip()
    return s.rstrip()


class _Flow:
    """Scalars and the collections written in brackets and braces."""

    def __init__(self, text: str, anchors: dict):
        self.text, self.at, self.anchors = text, 0, anchors

    def blank(self):
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1

    def value(self, ends: str):
        self.blank()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.items("]", self.value)
        if c == "{":
            return dict(self.items("}", self.pair))
        if c and c in "\"'":
            m = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"", re.S).match(self.text, self.at)
            if not m:
                raise YamlError(f"a quote is not closed: {self.text!r}")
            self.at = m.end()
            return _unquoted(m.group())
        m = re.compile(rf"(?:(?!: |:$)[^{re.escape(ends)}])*").match(self.text, self.at)
        self.at = m.end()
        word = m.group().strip()
        return self.anchors[word[1:]] if word.startswith("*") and word[1:] in self.anchors else _plain(word)

    def pair(self, ends: str):
        key = self.value(":" + ends)
        self.blank()
        if self.text[self.at : self.at + 1] != ":":
            return str(key), None
        self.at += 1
        return str(key), self.value(ends)

    def items(self, close: str, one):
        self.at += 1
        out = []
        while True:
            self.blank()
            c = self.text[self.at : self.at + 1]
            if not c:
                raise YamlError(f"{close} is missing: {self.text!r}")
            if c == close:
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            out.append(one("," + close))


class _Reader:
    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").expandtabs(2).split("\n")
        self.at = 0
        self.anchors: dict = {}

    def ahead(self) -> tuple[int, str] | None:
        """Indent and text of the next line that says something."""
        while self.at < len(self.lines):
            line = _without_comment(self.lines[self.at])
            if line.strip() and line.strip() not in ("---", "..."):
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def node(self, least: int):
        """The block that begins at the next line, if it is indented by ``least`` at least."""
        here = self.ahead()
        if here is None or here[0] < least:
            return None
        indent, text = here
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if _key(text):
            return self.mapping(indent)
        self.at += 1
        return self.inline(text, indent - 1)

    def sequence(self, indent: int) -> list:
        out = []
        while (here := self.ahead()) and here[0] == indent and (here[1] == "-" or here[1].startswith("- ")):
            rest = here[1][1:].strip()
            nested = rest == "-" or rest.startswith("- ")
            if nested or _key(rest):
                # a list or mapping that begins behind the dash
                inner = indent + len(here[1]) - len(rest)
                self.lines[self.at] = " " * inner + self.lines[self.at].strip()[1:].strip()
                out.append(self.sequence(inner) if nested else self.mapping(inner))
            else:
                self.at += 1
                out.append(self.inline(rest, indent))
        return out

    def mapping(self, indent: int) -> dict:
        found: dict = {}
        while (here := self.ahead()) and here[0] == indent and (pair := _key(here[1])):
            key, rest = pair
            self.at += 1
            value = self.inline(rest, indent, in_mapping=True)
            if key == "<<":
                found = (value if isinstance(value, dict) else {}) | found
            else:
                found[key] = value
        return found

    def inline(self, rest: str, indent: int, in_mapping: bool = False):
        """The value that follows a key or a dash, with the lines that belong to it."""
        if m := re.match(r"&(\S+)\s*", rest):
            value = self.inline(rest[m.end() :], indent, in_mapping)
            self.anchors[m[1]] = value
            return value
        rest = re.sub(r"^!\S*\s*", "", rest)
        if m := BLOCK.match(rest):
            return self.block(m[1], m[2] or m[4], indent + int(m[3]) if m[3] else 0, indent)
        if not rest:
            here = self.ahead()
            if here is None:
                return None
            # a list may stand as far left as the key that it belongs to
            dash = in_mapping and here[0] == indent and (here[1] == "-" or here[1].startswith("- "))
            return self.node(indent if dash else indent + 1)
        while (here := self.ahead()) and here[0] > indent:  # a value over several lines
            rest += ("\n" if rest[0] in "[{" else " ") + here[1]
            self.at += 1
        while rest[0] in "[{\"'":
            try:
                return _Flow(rest, self.anchors).value("")
            except YamlError:  # what opened may close further down, however little that line is indented
                here = self.ahead()
                if here is None:
                    raise
                rest += "\n" + here[1]
                self.at += 1
        return self.anchors[rest[1:]] if rest[0] == "*" and rest[1:] in self.anchors else _plain(rest)

    def block(self, style: str, chomp: str, inner: int, indent: int) -> str:
        """The lines of a block scalar as they stand, comments and blank lines included."""
        got: list[str] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            wide = len(line) - len(line.lstrip(" "))
            if line.strip():
                if wide <= indent:
                    break
                inner = inner or wide
                if wide < inner:
                    break
            got.append(line[inner:] if inner else "")
            self.at += 1
        kept = len(got)
        while kept and not got[kept - 1].strip():
            kept -= 1
        body, extra = got[:kept], len(got) - kept
        if style == "|":
            text = "\n".join(body)
        else:
            text = ""
            for i, line in enumerate(body):
                before = body[i - 1] if i else ""
                wide = line[:1] == " " or before[:1] == " "
                text += line if not i else ("\n" + line if wide or not line else line if not before else " " + line)
        return text if chomp == "-" or not body else text + "\n" * (1 + extra if chomp == "+" else 1)


def read_yaml(text: str):
    """What configuration files use of YAML: nested mappings and lists in both styles, scalars plain, quoted or as blocks,
    anchors, merged mappings and comments; one document."""
    got = _Reader(text.removeprefix("\ufeff")).node(0)
    return {} if got is None else got


def _key(s: str):
    """(key, rest) of a line that begins with a key."""
    m = re.match(r"('(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\")\s*:(?:\s+|$)", s)
    if m:
        return _unquoted(m[1]), s[m.end() :].strip()
    m = re.match(r"(?![\[{\"'|>&*!%@`])(.*?)\s*:(?:\s+|$)", s)
    return (str(m[1]), s[m.end() :].strip()) if m and m[1] else None


def write_yaml(value, indent: int = 0) -> str:
    pad = " " * indent
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            out.append(f"{pad}{_text(str(k))}:\n{write_yaml(v, indent + 2)}" if isinstance(v, (dict, list)) and v else f"{pad}{_text(str(k))}: {_text(v)}\n")
        return "".join(out)
    if isinstance(value, list):
        out = []
        for v in value:
            if isinstance(v, (dict, list)) and v:
                body = write_yaml(v, indent + 2)
                out.append(f"{pad}- {body[indent + 2 :]}")
            else:
                out.append(f"{pad}- {_text(v)}\n")
        return "".join(out)
    return f"{pad}{_text(value)}\n"


def _text(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    if v == [] or v == {}:
        return "[]" if v == [] else "{}"
    plain = v and v == v.strip() and _plain(v) == v and not any(c in v for c in ":#\n\t\r\"'{}[],\\") and v[0] not in "-&*!|>%@`?"
    return v if plain else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


@dataclass(frozen=True)
class Provider:
    base_url: str = ""
    api_key: str = ""
    model: str = ""
    dimensions: int = 0


@dataclass(frozen=True)
class Config:
    llm: Provider = field(default_factory=Provider)
    embedder: Provider = field(default_factory=Provider)
    reranker: Provider = field(default_factory=Provider)
    port: int = DEFAULT_PORT


#: Environment variables that override the file.
ENVIRONMENT = {"llm": "LLM", "embedder": "EMBED", "reranker": "RERANK"}


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The file (missing is fine), then environment variables, then defaults."""
    env = dict(os.environ) if env is None else env
    data = read_yaml(Path(path).read_text()) if path and Path(path).exists() else {}
    parts = {}
    for name, prefix in ENVIRONMENT.items():
        given = {k: v for k, v in (data.get(name) or {}).items() if k in Provider.__dataclass_fields__ and v is not None}
        p = Provider(**given)
        for k in ("base_url", "api_key", "model"):
            v = env.get(f"{prefix}_{k.upper()}")
            p = replace(p, **{k: v}) if v else p
        parts[name] = p
    port = env.get("PORT") or data.get("port") or DEFAULT_PORT
    return Config(**parts, port=int(port))


def problems(c: Config) -> list[str]:
    """What keeps a configuration from being used to compile or serve."""
    out = [f"llm.{k} is missing" for k in ("base_url", "api_key", "model") if not getattr(c.llm, k)]
    out += [f"embedder.{k} is missing" for k in ("base_url", "api_key") if not getattr(c.embedder, k)]
    if c.embedder.dimensions < 0:
        out.append("embedder.dimensions is negative")
    return out


def validate(c: Config) -> Config:
    if found := problems(c):
        raise ConfigError("; ".join(found))
    return c


def embedder_settings(agent: dict) -> tuple[int, int, bool]:
    """Dimensions, token limit and parallel mode of an agent file; anything amiss counts as 0, 0, False."""
    e = ((agent.get("runtime") or {}).get("embedder") or {}) if isinstance(agent, dict) else {}
    number = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else 0
    return number(e.get("dimensions")), number(e.get("max_tokens")), e.get("parallel") is True


def dimensions(agent: dict, c: Config) -> int:
    """The agent file comes first, then the configuration, then the default."""
    own = embedder_settings(agent)[0]
    return own if own > 0 else c.embedder.dimensions if c.embedder.dimensions > 0 else DEFAULT_DIMENSIONS


def ensure_skeleton(path: str) -> bool:
    """Write an empty configuration once, readable by its owner only; True if it was written."""
    p = Path(path)
    if p.exists():
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    blank = {"base_url": "", "api_key": "", "model": ""}
    p.write_text(write_yaml({"llm": blank, "embedder": blank | {"dimensions": DEFAULT_DIMENSIONS}, "reranker": blank, "port": DEFAULT_PORT}))
    p.chmod(0o600)
    return True
