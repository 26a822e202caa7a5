"""Schema-dialect patterns rewritten to the JVM's regular expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

from plumbline.functions.text import NAME_EXTRA, NAME_START

# What the dialect's escapes mean.
ESCAPES = {
    "d": r"\p{Nd}", "D": r"\P{Nd}",
    "s": r"[ \t\n\r]", "S": r"[^ \t\n\r]",
    "w": r"[^\p{P}\p{Z}\p{C}]", "W": r"[\p{P}\p{Z}\p{C}]",
    "i": f"[{NAME_START}]", "I": f"[^{NAME_START}]",
    "c": f"[{NAME_START}{NAME_EXTRA}]", "C": f"[^{NAME_START}{NAME_EXTRA}]",
}


def translate(pattern: str) -> str | None:
    """The anchored JVM pattern, or None when the spelling cannot be read (it then rejects nothing)."""
    text = _rewrite(pattern)
    session = SparkSession.getActiveSession()
    if text is not None and session is not None and hasattr(session, "_jvm") and not _compiles(session, text):
        return None
    return None if text is None else rf"\A(?:{text})\z"


_checked: dict[str, bool] = {}


def _compiles(session: SparkSession, text: str) -> bool:
    if text not in _checked:
        try:
            session._jvm.java.util.regex.Pattern.compile(text)
            _checked[text] = True
        except Exception:
            _checked[text] = False
    return _checked[text]


@lru_cache(maxsize=4096)
def _rewrite(pattern: str) -> str | None:
    out, depth, i = [], 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in ESCAPES:
                out.append(ESCAPES[nxt])
            elif nxt in "pP" and pattern.startswith("{Is", i + 2):
                out.append(f"\\{nxt}{{In")
                i += 3
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[":
            if depth and out and out[-1] == "-":
                out[-1] = "&&"
                inner = pattern.startswith("[^", i)
                out.append("[" if inner else "[^")
                i += 2 if inner else 1
            else:
                out.append("[")
                i += 1
                if pattern.startswith("^", i):
                    out.append("^")
                    i += 1
            depth += 1
            continue
        if ch == "]" and depth:
            depth -= 1
        elif ch in "^$" and not depth:
            ch = "\\" + ch
        elif ch == "&" and depth:
            ch = "\\&"
        out.append(ch)
        i += 1
    if depth:
        return None
    return "".join(out)
