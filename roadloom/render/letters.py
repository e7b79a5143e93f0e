"""Letters as strokes, for pictures that are made without a drawing library."""

from __future__ import annotations

import numpy as np

#: Strokes between the places of a grid of three columns and five rows, ``abc`` at the top, then ``def``, ``ghi``, ``jkl`` and ``mno``. Small letters are drawn as capitals.
STROKES = {
    "A": "mdbfo gi", "B": "amnlhfba gh", "C": "cbdjno", "D": "abflnma", "E": "camo gh", "F": "cam gh", "G": "cbdjnoih", "H": "am co gi",
    "I": "ac bn mo", "J": "clnj", "K": "am cgo", "L": "amo", "M": "maeco", "N": "maoc", "O": "bdjnlfb", "P": "mabfhg", "Q": "bdjnlfb ko",
    "R": "mabfhg ho", "S": "cbdhlnm", "T": "ac bn", "U": "ajnlc", "V": "anc", "W": "amkoc", "X": "ao cm", "Y": "ahc hn", "Z": "acmo",
    "0": "bdjnlfb fj", "1": "dbn mo", "2": "dbfmo", "3": "achlnj", "4": "nbgi", "5": "caghlnm", "6": "cbdjnlhg", "7": "acn", "8": "bdhlnjhfb",
    "9": "igdbfln", "-": "gi", ".": "nn", ",": "km", "/": "cm", "(": "bdjn", ")": "bfln", ":": "ee kk", "_": "mo", "+": "gi ek",
}
_PLACES = {chr(97 + k): (k % 3, k // 3) for k in range(15)}
#: Width of a letter with its gap, in heights of a letter.
ADVANCE = 0.75


def width(text: str, size: float) -> float:
    return len(text) * size * ADVANCE


def write(pixels: np.ndarray, text: str, x: float, y: float, size: float, ink=(0, 0, 0), anchor: str = "start", upwards: bool = False, bold: int = 1) -> None:
    """Draw ``text`` with its baseline's start (or ``middle``) at (x, y), ``size`` pixels high; ``upwards`` turns it a quarter to the left."""
    start = -width(text, size) / 2 if anchor == "middle" else 0.0
    for k, letter in enumerate(text.upper()):
        for stroke in STROKES.get(letter, "").split():
            for a, b in zip(stroke, stroke[1:]):
                (ax, ay), (bx, by) = _PLACES[a], _PLACES[b]
                n = int(size) + 2
                along = start + (k * ADVANCE + np.linspace(ax, bx, n) / 4) * size
                above = (4 - np.linspace(ay, by, n)) / 4 * size
                px, py = (x - above, y - along) if upwards else (x + along, y - above)
                for dx in range(bold + 1):
                    for dy in range(bold + 1):
                        cx, cy = np.rint(px).astype(int) + dx, np.rint(py).astype(int) + dy
                        inside = (cx >= 0) & (cx < pixels.shape[1]) & (cy >= 0) & (cy < pixels.shape[0])
                        pixels[cy[inside], cx[inside]] = ink
