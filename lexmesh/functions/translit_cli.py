"""Transliterate a file, a text or standard input: python -m lexmesh.functions.translit_cli [-e ENCODING] [-c TEXT] [FILE]."""

from __future__ import annotations

import argparse
import locale
import sys

from lexmesh.functions.translit import transliterator


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Unicode text to ASCII")
    parser.add_argument("-e", "--encoding", default=locale.getpreferredencoding())
    parser.add_argument("-c", dest="text")
    parser.add_argument("path", nargs="?")
    given = parser.parse_args(args)
    if given.path and given.text:
        print("a file and -c exclude each other", file=sys.stderr)
        return 1
    whole = transliterator({})
    if given.text:
        print(whole(given.text))
        return 0
    with open(given.path, "rb") if given.path else sys.stdin.buffer as stream:
        for number, line in enumerate(stream):
            try:
                sys.stdout.write(whole(line.decode(given.encoding)))
            except UnicodeDecodeError as e:
                print(f"line {number} is not {given.encoding}: {e.reason}", file=sys.stderr)
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
