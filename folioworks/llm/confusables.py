"""Letters of equal shape from the public Unicode confusables data."""

from __future__ import annotations

import functools
import glob
import os
import struct
import unicodedata
import zipfile

#: Where the data lies: ``confusables.txt``, a ``.cfu`` file, or an ICU4J jar, such as Spark brings along.
CONFUSABLES = os.environ.get("FOLIOWORKS_CONFUSABLES", "")
_INSIDE = "com/ibm/icu/impl/data/icudata/confusables.cfu"
_MAGIC = 0x3845FDEF


def default_path() -> str | None:
    """The named file, or the ICU4J jar of the Spark that runs; null if there is none."""
    if CONFUSABLES:
        return CONFUSABLES
    import pyspark

    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    found = [p for h in homes if h for p in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))]
    return found[-1] if found else None


def _binary(data: bytes) -> dict[int, str]:
    """The skeletons of a ``.cfu`` file: a header, keys (length and code point), values, and a string pool."""
    big = data[8] == 1
    order = ">" if big else "<"
    base = struct.unpack_from(order + "H", data, 0)[0]
    magic, _, _, keys, n, values, _, strings, n_strings = struct.unpack_from(order + "9i", data, base)
    if magic != _MAGIC:
        raise ValueError("not confusables data")
    pool = data[base + strings : base + strings + 2 * n_strings].decode("utf-16-be" if big else "utf-16-le", "surrogatepass")
    units = pool.encode("utf-16-le", "surrogatepass")
    out = {}
    for i in range(n):
        key = struct.unpack_from(order + "I", data, base + keys + 4 * i)[0]
        value = struct.unpack_from(order + "H", data, base + values + 2 * i)[0]
        length = (key >> 24) + 1
        raw = struct.pack("<H", value) if length == 1 else units[2 * value : 2 * (value + length)]
        out[key & 0x1FFFFF] = raw.decode("utf-16-le", "surrogatepass")
    return out


def skeletons(path: str) -> dict[int, str]:
    """What every confusable code point stands for, as the data says."""
    if path.endswith(".jar"):
        with zipfile.ZipFile(path) as z:
            return _binary(z.read(_INSIDE))
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".cfu"):
        return _binary(data)
    out = {}
    for line in data.decode("utf-8-sig").splitlines():
        parts = line.partition("#")[0].split(";")
        if len(parts) >= 2:
            out[int(parts[0], 16)] = "".join(chr(int(x, 16)) for x in parts[1].split())
    return out


def _case(ch: str) -> str:
    return {"Lu": "upper", "Ll": "lower"}.get(unicodedata.category(ch), "none")


@functools.cache
def letter_shapes(path: str | None = None) -> tuple[tuple[int, int], ...]:
    """Pairs (code point, code point of equal shape): letters and symbols that look like a basic Latin or, failing that, a Russian letter.

    Code points are of one shape when their skeletons are equal. A letter goes to the letter of its own
    case; one without case, or a letterlike symbol, only where its shape is that of a single letter. Latin
    letters, the Russian alphabet, digits, operators, raised and lowered letters and whatever has a canonical
    decomposition stay as they are. Without the data there are no pairs.
    """
    path = path or default_path()
    if path is None:
        return ()
    skeleton = skeletons(path)
    latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    russian = [chr(c) for c in (*range(0x410, 0x450), 0x401, 0x451)]
    targets: dict[str, list[list[str]]] = {}
    for rank, letters in enumerate((latin, russian)):
        for ch in letters:
            targets.setdefault(skeleton.get(ord(ch), ch), [[], []])[rank].append(ch)
    out = []
    for c in sorted({*skeleton, *(ord(t) for t in targets if len(t) == 1)}):
        ch = chr(c)
        category, apart = unicodedata.category(ch), unicodedata.decomposition(ch)
        if c < 0x80 or ch in russian or category[0] != "L" and not 0x2100 <= c < 0x2150 or category == "Lm" or apart.startswith(("<super>", "<sub>")):
            continue
        if apart and apart[0] != "<" or unicodedata.name(ch, "").startswith("LATIN "):
            continue
        for letters in targets.get(skeleton.get(c, ch), ()):
            fit = [x for x in letters if _case(x) == _case(ch)] if _case(ch) != "none" else letters
            if len(fit) == 1:
                out.append((c, ord(fit[0])))
                break
    return tuple(out)
