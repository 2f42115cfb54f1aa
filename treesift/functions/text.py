"""Folding and classification of file names.

Three spellings of a name are searched: as it is (NFC), with A-Z lower-cased, and, only where a name
has a character beyond ASCII, without case and accents.  The last needs Unicode tables that Spark SQL
has no function for, so it is an Arrow UDF, applied once when entries are ingested and only to names
that need it; queries read its result as a column.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..sources.keep import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)

# The extensions of each category, in the order of their bits.
CATEGORIES = {
    "documents": "pdf doc docx txt rtf pages md markdown odt tex epub xls xlsx csv ppt pptx key numbers",
    "images": "jpg jpeg png gif bmp tiff tif heic heif webp svg raw cr2 nef arw dng psd ico",
    "audio": "mp3 wav flac aac m4a ogg oga aiff aif wma alac opus",
    "video": "mp4 mov avi mkv wmv flv webm m4v mpg mpeg 3gp m2ts mts",
    "archives": "zip rar 7z tar gz tgz bz2 xz dmg iso pkg cab",
    "apps": "app pkg dmg exe",
}
# Extensions of directories that act as files.
PACKAGES = "app bundle appex plugin kext mlmodelc xcodeproj playground docset photoslibrary musiclibrary tvlibrary fcpbundle".split()

BITS = {name: 1 << i for i, name in enumerate(CATEGORIES)}
MASKS: dict[str, int] = {}
for _name, _extensions in CATEGORIES.items():
    for _ext in _extensions.split():
        MASKS[_ext] = MASKS.get(_ext, 0) | BITS[_name]


def ascii_lower(text: str) -> str:
    return text.translate(_TO_LOWER)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def search_fold(text: str) -> str:
    """What a search term is compared as: A-Z lower-cased; beyond ASCII also without case and accents."""
    if text.isascii():
        return ascii_lower(text)
    bare = "".join(c for c in unicodedata.normalize("NFD", nfc(text).lower()) if unicodedata.category(c) != "Mn")
    return nfc(bare)


@F.pandas_udf(StringType())
def _nfc_udf(names: pd.Series) -> pd.Series:
    return names.map(nfc, na_action="ignore")


@F.pandas_udf(StringType())
def _fold_udf(names: pd.Series) -> pd.Series:
    return names.map(search_fold, na_action="ignore")


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def nfc_column(c: Column) -> Column:
    ship()
    return _nfc_udf(c)


def unicode_fold(c: Column) -> Column:
    """The fold without accents; null for names in ASCII alone."""
    ship()
    return F.when(~is_ascii(c), _fold_udf(F.when(~is_ascii(c), c)))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def last_extension(fold: Column) -> Column:
    """What follows the last dot: null without a dot, empty for a trailing one, `bashrc` for `.bashrc`."""
    return F.when(F.contains(fold, F.lit(".")), F.substring_index(fold, ".", -1))


def shown_extension(name: Column) -> Column:
    """The extension as displayed: none for a leading dot alone or a trailing one."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^./ ]+)$", 1))


def type_mask(ext: Column) -> Column:
    """The categories of an extension as bits."""
    groups: dict[int, list[str]] = {}
    for e, mask in MASKS.items():
        groups.setdefault(mask, []).append(e)
    out = F.lit(0)
    for mask, extensions in sorted(groups.items()):
        out = F.when(ext.isin(extensions), F.lit(mask)).otherwise(out)
    return out


def category_mask(operand: str) -> int:
    """The bits that a `type:` operand names; 0 if it names none."""
    out = 0
    for part in operand.split(","):
        out |= BITS.get(part.strip().lower(), 0)
    return out


def kind(obj_type: Column, name: Column) -> Column:
    """A display label of what an entry is."""
    ext = F.upper(shown_extension(name))
    return (
        F.when(obj_type == 5, "Alias")
        .when((obj_type == 2) & (ext == ""), "Folder")
        .when((obj_type == 2) & F.lower(ext).isin(PACKAGES), "Bundle")
        .when(obj_type == 2, "Folder")
        .when(ext == "", "Document")
        .otherwise(F.concat(ext, F.lit(" file")))
    )


def tag_name(tag: Column) -> Column:
    """A tag's name in lower case, without the colour that follows a line end."""
    return F.lower(F.substring_index(tag, "\n", 1))
