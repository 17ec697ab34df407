"""URLs as browsers read and write them (the URL Standard): parse one against a base, write it out, None if it cannot be.

The standard's states are taken component by component: scheme, authority, path, query and
fragment are cut apart first, since each has delimiters of its own, and then each is
encoded by its own set. Left out: drive letters of file URLs, and of UTS 46 the rules on
right-to-left and joiner context; lengths of names are not checked, as the standard says.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Schemes whose URLs have a host and a root, with the port that is not written.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
#: Printable ASCII that each component percent-encodes; controls and all beyond U+007E are encoded in each.
IN_FRAGMENT = ' "<>`'
IN_QUERY = ' "#<>'
IN_SPECIAL_QUERY = IN_QUERY + "'"
IN_PATH = IN_QUERY + "?^`{}"
IN_USER = IN_PATH + "/:;=@[\\]|"
#: Characters that no host has, and those that no domain has besides.
NOT_IN_HOST = "\0\t\n\r #/:<>?@[\\]^|"
_NOT_IN_DOMAIN = re.compile("[" + re.escape(NOT_IN_HOST + "%") + "\x00-\x1f\x7f]")
_NOT_IN_HOST = re.compile("[" + re.escape(NOT_IN_HOST) + "]")
#: Characters that a name is read without, and full stops of other scripts.
_IGNORED = re.compile("[\u00ad\u034f\u180b-\u180d\u180f\u200b\u2060\u2064\ufe00-\ufe0f\ufeff]")
_STOPS = re.compile("[\u3002\uff0e\uff61]")
_KEPT = {"\u00df", "\u03c2", "\u200c", "\u200d"}

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_ONE_DOT = re.compile(r"(?:\.|%2e)", re.I)
_TWO_DOTS = re.compile(r"(?:\.|%2e){2}", re.I)


class Url(NamedTuple):
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    #: segments, or one string where the path is opaque (mailto:...)
    path: tuple[str, ...] | str = ()
    query: str | None = None
    fragment: str | None = None

    @property
    def href(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            user = self.user + (":" + self.password if self.password else "")
            out += "//" + (user + "@" if user else "") + self.host + (f":{self.port}" if self.port is not None else "")
        elif not isinstance(self.path, str) and len(self.path) > 1 and not self.path[0]:
            out += "/."  # or two slashes would begin a host
        out += self.path if isinstance(self.path, str) else "".join("/" + s for s in self.path)
        return out + ("" if self.query is None else "?" + self.query) + ("" if self.fragment is None else "#" + self.fragment)


@lru_cache(maxsize=16)
def _encoder(chars: str) -> re.Pattern:
    return re.compile("[" + re.escape(chars) + "\x00-\x1f\x7f-\U0010ffff]")


def encoded(text: str, chars: str) -> str:
    return _encoder(chars).sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


def _decoded(text: str) -> str:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace")).decode("utf-8", "replace")


def _number(part: str) -> int:
    if re.fullmatch(r"0[xX][0-9a-fA-F]*", part):
        return int(part[2:] or "0", 16)
    return int(part, 8) if len(part) > 1 and part.startswith("0") else int(part)


def ipv4(name: str) -> ipaddress.IPv4Address | None:
    """A host that browsers read as an IPv4 address, such as 127.1, 0x7f.1 or 2130706433."""
    parts = name.rstrip(".").split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", p, re.A) for p in parts):
        return None
    try:
        *before, last = [_number(p) for p in parts]
    except ValueError:  # 08, or more digits than any number here has
        return None
    if any(n > 255 for n in before) or last >= 256 ** (4 - len(before)):
        return None
    return ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(before)) + last)


def _ipv6(text: str) -> str | None:
    """The shortest spelling; the longest run of zeros, of equal runs the first, is left out."""
    try:
        if "%" in text:
            return None
        groups = [f"{(int(ipaddress.IPv6Address(text)) >> 16 * i) & 0xFFFF:x}" for i in range(7, -1, -1)]
    except ValueError:
        return None
    runs = [m.span() for m in re.finditer(r"0{2,}", "".join("0" if g == "0" else "x" for g in groups))]
    if not runs:
        return "[" + ":".join(groups) + "]"
    a, b = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    return "[" + ":".join(groups[:a]) + "::" + ":".join(groups[b:]) + "]"


def _valid_label(label: str) -> bool:
    return (
        unicodedata.normalize("NFC", label) == label and not unicodedata.category(label[0]).startswith("M")
        and all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs", "Zs", "Zl", "Zp") for c in label)
    )


def _ascii_label(label: str) -> str | None:
    if label.startswith("xn--"):
        try:
            plain = label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError, OverflowError):
            return None
        again = bool(plain) and not plain.isascii() and plain == _mapped(plain) and _valid_label(plain)
        return label if again else None
    if label.isascii():
        return label
    return "xn--" + label.encode("punycode").decode() if _valid_label(label) else None


def _mapped(name: str) -> str:
    """Case folded and composed, as names of UTS 46 are read (sharp s, final sigma and joiners stay)."""
    name = _STOPS.sub(".", _IGNORED.sub("", name)).replace("\u1e9e", "\u00df")
    once = "".join(c if c in _KEPT else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in name)
    return unicodedata.normalize("NFC", once)


def _domain(text: str) -> str | None:
    name = _decoded(text)
    name = name.lower() if name.isascii() else _mapped(name)
    if "\ufffd" in name:
        return None
    labels = [_ascii_label(label) for label in name.split(".")]
    if None in labels:
        return None
    out = ".".join(labels)
    if not out or _NOT_IN_DOMAIN.search(out):
        return None
    last = (out[:-1] if out.endswith(".") else out).rpartition(".")[2]
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", last):
        number = ipv4(out)
        return None if number is None else str(number)
    return out


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") else None
    if special:
        return _domain(text)
    return None if _NOT_IN_HOST.search(text) else encoded(text, "")


def _with_authority(url: Url, text: str) -> Url | None:
    """url with user, host and port from what stands between // and the path."""
    special = url.scheme in SPECIAL
    credentials, at, place = text.rpartition("@")
    if at:
        user, _, password = credentials.partition(":")
        url = url._replace(user=encoded(user, IN_USER), password=encoded(password, IN_USER))
    name, port = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(.*)", place, re.S).groups()
    if port and not port.startswith(":") or not name and (at or port or special and url.scheme != "file"):
        return None
    host = _host(name, special) if name else ""
    if host is None or not re.fullmatch(r":?[0-9]*", port) or url.scheme == "file" and (at or port):
        return None
    if url.scheme == "file" and host == "localhost":
        host = ""
    digits = port[1:].lstrip("0")
    if len(digits) > 5 or int(digits or "0") > 65535:
        return None
    number = int(digits or "0") if port[1:] else None
    return url._replace(host=host, port=None if number == SPECIAL.get(url.scheme) else number)


def _with_path(url: Url, text: str, before: tuple[str, ...] = ()) -> Url:
    """url with the segments of text after those of before; dots are walked."""
    parts = re.split(r"[/\\]" if url.scheme in SPECIAL else "/", text)
    path = list(before)
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if _TWO_DOTS.fullmatch(part):
            del path[-1:]
        elif not _ONE_DOT.fullmatch(part):
            path.append(encoded(part, IN_PATH))
            continue
        if last:
            path.append("")
    return url._replace(path=tuple(path))


def parse(text: str, base: Url | None = None) -> Url | None:
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text, sharp, fragment = text.partition("#")
    ending = encoded(fragment, IN_FRAGMENT) if sharp else None
    named = _SCHEME.match(text)
    if named:
        scheme, rest = named[1].lower(), text[named.end() :]
    elif base is None:
        return None
    else:
        scheme, rest = base.scheme, text
    special = scheme in SPECIAL
    rest, asks, query = rest.partition("?")
    search = encoded(query, IN_SPECIAL_QUERY if special else IN_QUERY) if asks else None
    url = Url(scheme, query=search, fragment=ending)
    slashes = re.match(r"[/\\]*" if special else "/*", rest)[0]
    if named and not special and not slashes:
        return url._replace(path=encoded(rest, ""))
    relative = not named or special and base is not None and base.scheme == scheme and len(slashes) < 2
    if relative and isinstance(base.path, str):
        return base._replace(fragment=ending) if not text and sharp else None
    if len(slashes) > 1 or named and special and not relative and scheme != "file":
        after = rest[2:] if not special or scheme == "file" else rest[len(slashes) :]
        authority = re.match(r"[^/\\]*" if special else "[^/]*", after)[0]
        held = _with_authority(url, authority)
        path = after[len(authority) :]
        return held and (_with_path(held, path[1:]) if path or special else held)
    if not relative:  # a file URL or one with an unknown scheme, without a host
        return _with_path(url._replace(host="" if special else None), rest[len(slashes) :])
    url = url._replace(user=base.user, password=base.password, host=base.host, port=base.port)
    if slashes:
        return _with_path(url, rest[1:])
    if not rest:
        return url._replace(path=base.path, query=search if asks else base.query)
    return _with_path(url, rest, base.path[:-1])


@lru_cache(maxsize=64)
def _base(text: str) -> Url | None:
    return parse(text)


def resolve(base: str, href: str) -> str | None:
    """href against base, written out; None if either cannot be read."""
    held = _base(base)
    out = held and parse(href, held)
    return out.href if out else None
