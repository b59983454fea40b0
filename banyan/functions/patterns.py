"""Patterns, one for each idea of a word character.

W is letters, numbers and underscore: social fields read marks of a script as
ends of a word.  Tokens and slang use ``(?U)\\w``, which takes marks along.
"""

W = r"[\p{L}\p{N}_]"
HASHTAG = f"#({W}+)"
MENTION = f"@({W}+)"
BENGALI = r"[\x{0980}-\x{09FF}]"
LATIN = "[A-Za-z]"
_ONE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}\x{24C2}]"
_MOD = r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]"
EMOJI_CHAR = _ONE
EMOJI = rf"(?:[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[#*0-9]\x{{FE0F}}?\x{{20E3}}|{_ONE}{_MOD}*(?:\x{{200D}}{_ONE}{_MOD}*)*+)"
URL = r"https?://\S+|www\.\S+"
#: Word characters at which no URL and no emoji can start: runs of them need no look ahead.
_PLAIN = r"[\w&&[^hw0-9\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}\x{24C2}]]"
#: Groups repeat possessively: other repeats of a group take a stack frame each, and a long run of them ends the JVM.
#: A word stops where a URL or an emoji starts, so that one pass finds what two would.
TOKEN = rf"(?U){URL}|#\w+|@\w+|{EMOJI}|(?:{_PLAIN}++|(?!https?://\S|www\.\S|{EMOJI})\w)++|[^\w\s]"
#: The tokens that pass through translation as they are. TOKEN finds the same ones, as none of its other parts takes their first character.
#: The look ahead, a class of all first characters, passes over the others at once.
PROTECTED = rf"(?U)(?=[hw#@*0-9\x{{1F1E6}}-\x{{1F1FF}}{_ONE[1:]})(?:{URL}|#\w+|@\w+|{EMOJI})"
WORD_OR_GAP = r"(?U)\w+|[^\w]+"
# Patterns that results depend on.
CAMEL = "[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[০-৯0-9]+|[\\x{0980}-\\x{09FF}]+"
WORD = r"[A-Za-z]+|[\x{0980}-\x{09FF}]+"
DANDA = r"(?<=[\x{0980}-\x{09FF}])\s*[|Il1]\s*(?=[\x{0980}-\x{09FF}]|\s|$)"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

#: White space of all scripts.
SPACE = r"(?U)\s"
#: White space at the end of a text; only a run's start is tried, so long runs inside a text cost no more than others.
AT_END = r"(?<!\s)\s++$"
