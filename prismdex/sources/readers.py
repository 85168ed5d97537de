"""Readers over Pillow, OpenCV and PyMuPDF; each imports its library when a file is opened."""

from __future__ import annotations

from prismdex.sources.decoders import Corrupt
from prismdex.settings import Settings

CAMERA, TAKEN = (271, 272), (36867, 306)


class ImageReader:
    def __init__(self, path: str, settings: Settings):
        from PIL import Image, ImageOps

        Image.MAX_IMAGE_PIXELS = settings.max_image_pixels
        try:
            self.image = Image.open(path)
            self.width, self.height = self.image.size
            self.meta = {"format": self.image.format or ""} | self._exif()
            self.image.draft("RGB", (settings.frame_max_side * 2,) * 2)
            self.image.load()
            self.image = ImageOps.exif_transpose(self.image)
        except Exception as e:
            raise Corrupt(str(e)) from e

    def _exif(self) -> dict[str, str]:
        try:
            tags = self.image.getexif()
            camera = " ".join(str(tags[t]).strip() for t in CAMERA if tags.get(t))
            taken = next((str(tags[t]) for t in TAKEN if tags.get(t)), "")
        except Exception:
            return {}
        return {k: v for k, v in (("camera", camera), ("taken", taken)) if v}

    def pixels(self, side: int):
        from PIL import Image

        image = self.image
        if image.mode in ("RGBA", "LA") or "transparency" in image.info:
            image = image.convert("RGBA")
            flat = Image.new("RGBA", image.size, "white")
            flat.alpha_composite(image)
            image = flat
        image = image.convert("RGB")
        image.thumbnail((side, side))
        return image


class VideoReader:
    def __init__(self, path: str, settings: Settings):
        import cv2

        self.path, self.side, self.cv2 = path, settings.frame_max_side, cv2
        self.video = cv2.VideoCapture(path)
        if not self.video.isOpened():
            raise Corrupt("cannot open video")
        number = lambda name: self.video.get(getattr(cv2, f"CAP_PROP_{name}"))
        self.fps, self.frames = number("FPS") or 0.0, int(number("FRAME_COUNT") or 0)
        self.width, self.height = int(number("FRAME_WIDTH")), int(number("FRAME_HEIGHT"))
        code = int(number("FOURCC"))
        self.codec = code.to_bytes(4, "little", signed=False).decode("latin-1").strip("\0 ") if code > 0 else ""

    def at(self, seconds: float):
        self.video.set(self.cv2.CAP_PROP_POS_MSEC, seconds * 1000)
        ok, frame = self.video.read()
        return self._picture(frame) if ok else None

    def each(self):
        video, index = self.cv2.VideoCapture(self.path), 0
        while True:
            ok, frame = video.read()
            if not ok:
                return
            yield index, self._picture(frame)
            index += 1

    def _picture(self, frame):
        from PIL import Image

        image = Image.fromarray(self.cv2.cvtColor(frame, self.cv2.COLOR_BGR2RGB))
        image.thumbnail((self.side, self.side))
        return image

    @staticmethod
    def deviation(picture) -> float:
        import numpy as np

        return float(np.asarray(picture.convert("L")).std())


class PdfReader:
    def __init__(self, path: str, settings: Settings):
        import pymupdf

        try:
            self.document = pymupdf.open(path)
        except Exception as e:
            raise Corrupt(f"cannot open PDF: {e}") from e
        self.library, self.locked = pymupdf, bool(self.document.needs_pass)
        self.pages = 0 if self.locked else self.document.page_count
        self.meta = self.document.metadata or {}
        first = self.document[0].rect if self.pages else None
        self.width, self.height = (int(first.width), int(first.height)) if first else (None, None)

    def text(self, page: int) -> str:
        return self.document[page].get_text("text")

    def picture(self, page: int, side: int):
        from PIL import Image

        own = self.document[page]
        scale = side / max(own.rect.width, own.rect.height, 1)
        drawn = own.get_pixmap(matrix=self.library.Matrix(scale, scale), colorspace=self.library.csRGB, alpha=False)
        return Image.frombytes("RGB", (drawn.width, drawn.height), drawn.samples)


_speech: dict[str, object] = {}


def open_speech(path: str, settings: Settings) -> list[tuple[float, str]]:
    """Segments (start, text) of what is said in a file; the model is loaded once in a worker."""
    from faster_whisper import WhisperModel

    if settings.asr_model not in _speech:
        _speech[settings.asr_model] = WhisperModel(settings.asr_model, device="cpu", compute_type="int8")
    segments, _ = _speech[settings.asr_model].transcribe(path)
    return [(s.start, s.text) for s in segments]


open_image, open_video, open_pdf = ImageReader, VideoReader, PdfReader
