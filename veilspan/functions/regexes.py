"""Regular-expression dialect helpers for java.util.regex."""
from __future__ import annotations

# Whitespace in the Unicode sense the rules are written for (java's \s is ASCII only).
_WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = rf"[\x00-\x20\u00a0-\uffff&&[{_WS}]]"  # the intersection spares ordinary letters the ten tests of the inner class
# Every run of whitespace but a lone blank: replacing these by a blank squeezes a text.
WS_RUN = f" {WS}+|(?! ){WS}+"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_WS = f"[^{_WS}]"
# ASCII word boundaries (java's \b also looks at accented letters): before and after a word.
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def rx(pattern: str, flags: str = "") -> str:
    r"""Write \s and \b of a rule out for java: wide whitespace, ASCII word boundary.

    A boundary is cheap only when its side is known, so rules use it next to a word only.
    `flags` "i" is case-insensitive including accented letters, "m" is multi-line anchors.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "s":
                out.append(_WS if in_class else WS)
            elif n == "S" and not in_class:
                out.append(NOT_WS)
            elif n == "b" and not in_class:
                # at the head of a branch a word follows, anywhere else a word has just ended
                head = not out or out[-1] in ("(", "|", "?:")
                out.append(WORD_START if head else WORD_END)
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    head = {"": "", "i": "(?iu)", "m": "(?m)", "im": "(?ium)"}[flags]
    return head + "".join(out)
