"""Run options: parsing and checking of levels, sizes and command-line style arguments."""

from __future__ import annotations

import os
import re
import shlex
from dataclasses import dataclass, field, replace

#: Bytes of input that precede a chained block as its dictionary (RFC 1951's window).
DICTIONARY = 32 * 1024
MIN_BLOCK = 1024


def parse_level(text: str) -> int:
    """A level from 0 to 12."""
    if not re.fullmatch(r"\d{1,2}", text) or int(text) > 12:
        raise ValueError(f"compression level must be 0 to 12, not {text!r}")
    return int(text)


def parse_size(text: str) -> int:
    """Bytes in a size such as 131072, 128k or 1M; at least MIN_BLOCK."""
    m = re.fullmatch(r"(\d+)([kmg]?)", text.strip().lower())
    if not m:
        raise ValueError(f"not a block size: {text!r}")
    size = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]]
    if size < MIN_BLOCK:
        raise ValueError(f"block size must be at least {MIN_BLOCK} bytes")
    return size


@dataclass(frozen=True)
class CodecOptions:
    """Options of a run; each field has the command line's default."""

    files: tuple[str, ...] = ()
    level: int = 6
    threads: int = field(default_factory=lambda: os.cpu_count() or 1)
    block_size: int | None = None
    suffix: str = ".gz"
    decompress: bool = False
    stdout: bool = False
    keep: bool = False
    force: bool = False
    recursive: bool = False
    list: bool = False
    test: bool = False
    zlib: bool = False
    quiet: bool = False
    verbosity: int = 1
    mode: str = "PERMISSIVE"

    @property
    def effective_level(self) -> int:
        """The level used: zlib ends at 9."""
        return min(self.level, 9)

    @classmethod
    def from_args(cls, args: list[str], env: dict[str, str] | None = None) -> CodecOptions:
        """Options from arguments, those of the environment's PIGZ and GZIP before them (in this order)."""
        env = dict(os.environ) if env is None else env
        words = [*shlex.split(env.get("PIGZ", "")), *shlex.split(env.get("GZIP", "")), *args]
        out, files, at, plain = cls(), [], 0, False
        flags = {"d": "decompress", "c": "stdout", "k": "keep", "f": "force", "r": "recursive", "l": "list", "t": "test", "z": "zlib", "q": "quiet"}
        long = {"decompress": "d", "uncompress": "d", "stdout": "c", "to-stdout": "c", "keep": "k", "force": "f", "recursive": "r", "list": "l", "test": "t", "zlib": "z", "quiet": "q", "silent": "q", "verbose": "v", "fast": "1", "best": "9", "processes": "p", "blocksize": "b", "suffix": "S", "level": "L"}

        def valued(name: str, value: str) -> CodecOptions:
            if name == "p":
                if not value.isdigit() or not int(value):
                    raise ValueError(f"not a number of processes: {value!r}")
                return replace(out, threads=int(value))
            if name == "b":
                return replace(out, block_size=parse_size(value))
            return replace(out, suffix=value if value.startswith(".") else "." + value) if name == "S" else replace(out, level=parse_level(value))

        while at < len(words):
            word = words[at]
            at += 1
            if plain or word == "-" or not word.startswith("-"):
                files.append(word)
            elif word == "--":
                plain = True
            elif word.startswith("--"):
                name, _, value = word[2:].partition("=")
                if name not in long:
                    raise ValueError(f"unknown option: {word}")
                short = long[name]
                if short in "pbSL":
                    if not value:
                        if at == len(words):
                            raise ValueError(f"{word} needs a value")
                        value, at = words[at], at + 1
                    out = valued(short, value)
                elif short.isdigit():
                    out = replace(out, level=int(short))
                else:
                    out = replace(out, verbosity=out.verbosity + 1) if short == "v" else replace(out, **{flags[short]: True})
            else:
                rest = word[1:]
                while rest:
                    short, rest = rest[0], rest[1:]
                    if short.isdigit():
                        digits = re.match(r"1[0-2]|\d", short + rest)[0]
                        out, rest = replace(out, level=parse_level(digits)), rest[len(digits) - 1 :]
                    elif short in "pbS":
                        if not rest:
                            if at == len(words):
                                raise ValueError(f"-{short} needs a value")
                            rest, at = words[at], at + 1
                        out, rest = valued(short, rest), ""
                    elif short == "v":
                        out = replace(out, verbosity=out.verbosity + 1)
                    elif short in flags:
                        out = replace(out, **{flags[short]: True})
                    else:
                        raise ValueError(f"unknown option: -{short}")
        return replace(out, files=tuple(files))
