"""The readable text of a mail: parts found, transfer encoding, markup and
entities undone. Made for whole archives, so it is a few passes of compiled
patterns over a text and keeps what broken mails still hold."""

from __future__ import annotations

import binascii
import html
import re

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_HEADER = re.compile(r"\A(?:[!-9;-~]+:[^\n]*(?:\n|\Z)(?:[ \t][^\n]*(?:\n|\Z))*)+")
_TYPE = re.compile(r"^content-type:[ \t]*([^\s;]+)((?:[^\n]*(?:\n[ \t])?)*)", re.I | re.M)
_ENCODING = re.compile(r"^content-transfer-encoding:[ \t]*\"?([\w-]+)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary=(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset=\"?([\w.:-]+)", re.I)
_DROPPED = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
# Elements that don't break a word.
_INLINE = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def _bytes_to_text(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return data.decode("utf-8", errors="replace")


def decode_transfer(body: str, encoding: str, charset: str | None) -> str:
    """Undo base64 or quoted-printable; what can't be decoded stays as it is."""
    if encoding == "base64":
        clean = _NOT_BASE64.sub("", body)
        clean = clean[: len(clean) - (len(clean) % 4 == 1)]
        try:
            return _bytes_to_text(binascii.a2b_base64(clean + "=" * (-len(clean) % 4)), charset)
        except binascii.Error:
            return body
    if encoding == "quoted-printable":
        return _bytes_to_text(binascii.a2b_qp(body.encode()), charset)
    return body


def strip_markup(text: str) -> str:
    """The text of an HTML part: no comments, scripts, styles and tags; inline
    tags join what they part, all others break it; entities resolved."""
    text = _DROPPED.sub(" ", text)
    text = _INLINE_TAG.sub("", text)
    return html.unescape(_TAG.sub(" ", text))


def _headed(raw: str) -> tuple[str, str]:
    """(headers, body); what begins with a blank line has no headers."""
    header = _HEADER.match(raw)
    head = header[0] if header else ""
    return head, raw[len(head) :]


def text_parts(raw: str | None) -> list[str]:
    """The decoded text parts of a mail, in order, attached texts and enclosed
    mails included, other attachments left out. A null or empty mail has none; a
    text without headers is one plain part. Parts may be nested to any depth."""
    found: list[str] = []
    todo = [_headed(raw)] if raw else []
    while todo:
        inner = _part(*todo.pop(), found)
        todo += reversed(inner)
    return found


def _part(head: str, body: str, found: list[str]) -> list[tuple[str, str]]:
    """Text of a part goes to ``found``; the result are the parts inside it."""
    kind = _TYPE.search(head)
    name = kind[1].lower() if kind else "text/plain"
    rest = kind[2] if kind else ""
    encoding = _ENCODING.search(head)
    encoding = encoding[1].lower() if encoding else ""
    if name.startswith("multipart/"):
        mark = _BOUNDARY.search(rest) or _BOUNDARY.search(head)
        if not mark:
            found.append(body)
            return []
        pieces = re.split(rf"(?m)^--{re.escape(mark[1] or mark[2])}(--)?[ \t]*\r?$\n?", body)
        if len(pieces) == 1:
            found.append(body)
        inner = []
        for i in range(1, len(pieces), 2):
            if pieces[i] is None:
                text = pieces[i + 1]
                if name == "multipart/digest" and not _TYPE.match(text.lstrip("\r\n")):
                    text = text.lstrip("\r\n")
                inner.append(_headed(text))
        return inner
    if name.startswith("message/"):
        mail = decode_transfer(body, encoding, None).lstrip("\r\n")
        return [_headed(mail)] if mail else []
    if name.startswith("text/"):
        charset = _CHARSET.search(rest)
        text = decode_transfer(body, encoding, charset[1] if charset else None)
        found.append(strip_markup(text) if name == "text/html" else text)
    return []
