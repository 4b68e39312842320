"""Container sniffing on the first bytes of a blob."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def looks_like_wave(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "52494646"


def looks_like_mp3(content: Column) -> Column:
    """A tag, or a frame header: eleven set bits."""
    head = F.hex(F.substring(content, 1, 3))
    second = F.conv(F.substring(head, 3, 2), 16, 10).cast("int")
    return (head == "494433") | ((F.length(head) >= 4) & (F.substring(head, 1, 2) == "FF") & (F.coalesce(second, F.lit(0)).bitwiseAND(F.lit(0xE0)) == 0xE0))


def container(content: Column) -> Column:
    """wave, mp3 or unsupported."""
    return F.when(looks_like_wave(content), "wave").when(looks_like_mp3(content), "mp3").otherwise("unsupported")
