"""Fixed values that results depend on: word lists, file endings, weights and limits."""

from __future__ import annotations

# Words that a keyword search leaves out (fixed values).
STOP_WORDS = (
    "a an the of in on at to for and or with without by from is are was were be this that these those it its "
    "showing shows show containing contain contains related about images image photos photo pictures picture "
    "videos video clips clip footage brochures brochure documents document pdf pdfs files file"
).split()

# Words that point to a media type (fixed values).
INTENT_WORDS = {
    "video": "video videos clip clips footage".split(),
    "pdf": "brochure brochures pdf pdfs document documents flyer flyers catalog catalogue report manual".split(),
    "image": "image images photo photos picture pictures pic pics".split(),
}

# File endings by media type (fixed values).
ENDINGS = {
    "image": ".jpg .jpeg .png .webp .bmp .gif .tif .tiff".split(),
    "video": ".mp4 .mov .mkv .avi .webm .m4v .ogv .mpg .mpeg".split(),
    "pdf": [".pdf"],
}

# Names that a listing leaves out, in lower case (fixed values).
IGNORED_NAMES = [".ds_store", "thumbs.db", "desktop.ini"]

# Colour words of the deterministic visual encoder: red, green and blue parts (fixed values).
COLOURS = {
    "red": (1, 0, 0), "green": (0, 1, 0), "blue": (0, 0, 1), "yellow": (1, 1, 0),
    "white": (1, 1, 1), "cyan": (0, 1, 1), "magenta": (1, 0, 1),
}

# Ranking (fixed values).
RRF_K = 60
SIGNALS = ("clip", "text", "kw")
WEIGHTS = {"clip": 1.0, "text": 1.0, "kw": 0.5}
SECONDARY = 0.25
INTENT_BOOST = 1.3
KEYWORD_SHARE = 0.5
CANDIDATES = 200
KEYWORD_ROWS = 600
BM25_K1, BM25_B = 1.2, 0.75

# Text limits (fixed values).
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 900, 150, 20
TRANSCRIPT_OVER = 500
SNIPPET = 300
VISUAL_WORDS = 55
BUCKETS = 256
