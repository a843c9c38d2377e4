"""SQL pieces that the oracles of the corpus operators share."""

from attesta.queries.checksum import CRC_STEPS, crc_of

__all__ = ["CRC_STEPS", "LOWER", "crc_of"]

#: text with A-Z lower-cased and nothing else changed; null is empty
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
