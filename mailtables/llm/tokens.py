"""Token ids of whole texts by a public tokenizer, with a memory for words already seen.

The encoder gives exactly the ids of one call on the whole text. Both vocabularies cut a text
before a blank that follows a visible character, and no token crosses such a cut, so what stands
between two cuts is encoded once and looked up afterwards.
"""

import os
import re
from array import array

MEMORY = 400_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LOOSE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_MARKS = r"[!-&(-/:-@\[-`{-~]"
# A word and the marks behind it: what each vocabulary's own splitting rule keeps apart.
_WORD = re.compile(rf"( ?)([{LETTERS}]*)({_MARKS}*)")


class Memory(dict):
    """Two generations of known pieces; the older one is dropped when the younger is full."""

    def __init__(self, make, size=MEMORY):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """``encoder(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        splitter = ByteLevel(add_prefix_space=False, use_regex=False)
        # The vocabulary's sign for each byte that these letters and the blank have in UTF-8.
        self.signs = {}
        for code in range(256):
            shown = splitter.pre_tokenize_str(chr(code))[0][0]
            self.signs.update(zip(chr(code).encode(), shown))
        self.signs[" "] = self.signs[32]
        self.part = Memory(self._part)
        self.after_blank = Memory(self._behind_blank)
        self.other = Memory(self._piece, MEMORY // 4)

    def _behind_blank(self, s):
        """A piece and the blank before it; a word with marks behind it is put together from both."""
        if s.isascii():
            if s.isalpha():
                return self._ids(s.lower() if self.lower else self.signs[" "] + s)
            if s[:-1].isalpha() and s[-1] in ",.;:!?":
                return self.after_blank[s[:-1]] + self.part[s[-1]]
        return self._piece(" " + s)

    def _part(self, s):
        """A piece that the vocabulary's splitting rule leaves whole."""
        if self.lower:
            s = s.lower()
        if not s.isascii() or s[0] in " \n":
            s = s.encode().decode("latin-1").translate(self.signs)
        return self._ids(s)

    def _ids(self, s):
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _line(self, s):
        """The ids of a word with marks behind it, or None for anything else."""
        known = _WORD.fullmatch(s)
        if not known:
            return None
        blank, word, marks = known.groups()
        if not word and not marks:
            return None
        if not self.lower:  # a blank belongs to what follows it
            word, marks = (blank + word, marks) if word else ("", blank + marks)
        if word and marks:
            return self.part[word] + self.part[marks]
        return self.part[word or marks]

    def _piece(self, s):
        made = self._line(s)
        if made is None and "\n" in s:
            # Single line ends between words stand alone.
            first, *rest = s.split("\n")
            lines = [self._line(first), *[self._line(x) if x[:1] != " " else None for x in rest]]
            if None not in lines:
                made = (b"" if self.lower else self.part["\n"]).join(lines)
        if made is None:
            made = array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
        return made

    def __call__(self, text):
        if _LOOSE.search(text):
            return b"".join([self.other[p] for p in _CUT.split(text)])
        first, *rest = text.split(" ")
        return self.other[first] + b"".join(map(self.after_blank.__getitem__, rest))


_encoders = {}


def encoder(path):
    """One encoder per process and path, kept from task to task until ``release``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release():
    """Drop the encoders that earlier stages left in this process: each knows up to 200 MB of pieces."""
    _encoders.clear()
