"""Media files as short texts, and readers for them: rules and engine are tested without any decoder library."""

from __future__ import annotations

import numpy as np

from prismdex.sources.decoders import Corrupt
from prismdex.sources.embedders import EmbedderFailure, PlainEmbedder


def content(path: str, magic: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        head, _, rest = f.read().partition("\n")
    if head != magic:
        raise Corrupt(f"no {magic} header")
    return rest.split("\n")


def solid(rgb) -> np.ndarray:
    return np.broadcast_to(np.array(rgb, np.float32), (4, 4, 3))


class Picture:
    width, height, meta = 64, 48, {"format": "TEXT"}

    def __init__(self, path, settings):
        self.rgb = [int(x) for x in content(path, "IMG")[0].split()]

    def pixels(self, side):
        return solid(self.rgb)


class Image:
    """What a thumbnail needs of an image object."""

    def __init__(self, pixels, side=0):
        self.pixels, self.side = pixels, side

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self.pixels, dtype)

    def copy(self):
        return Image(self.pixels)

    def thumbnail(self, size):
        self.side = size[0]

    def convert(self, mode):
        return self

    def save(self, out, kind, quality):
        out.write(f"{kind} of {self.side}".encode())


class Shown(Picture):
    def pixels(self, side):
        return Image(super().pixels(side))


class Video:
    """One colour a second at ten frames a second."""

    width, height, fps, codec = 96, 64, 10.0, "mp4v"

    def __init__(self, path, settings):
        self.seconds = [[int(x) for x in line.split()] for line in content(path, "VID")]
        self.frames = 10 * len(self.seconds)

    def at(self, t):
        return solid(self.seconds[int(t)])

    def each(self):
        return ((i, self.at(i / 10)) for i in range(self.frames))

    @staticmethod
    def deviation(picture):
        return 50.0


class Pdf:
    locked, width, height, meta = False, 595, 842, {}

    def __init__(self, path, settings):
        self.texts = content(path, "PDF")
        self.pages = len(self.texts)

    def text(self, page):
        return self.texts[page]

    def picture(self, page, side):
        return solid((255, 255, 255))


OPENERS = {"image": Picture, "video": Video, "pdf": Pdf}


class Failing(PlainEmbedder):
    def pictures(self, pictures):
        raise EmbedderFailure("no memory left")
