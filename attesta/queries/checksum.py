"""CRC-32 for SQL, which has no function for it."""

#: a CTE of one row: the table of the 256 byte steps
CRC_STEPS = """
crc_step AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps
)"""


def crc_of(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes; needs ``crc_step`` in scope."""
    code = f"hex(encode({text}))"
    return (f"xor(4294967295, list_reduce(list_transform(range(1, CAST(length({code}) / 2 AS BIGINT) + 1), lambda i: "
            f"CAST('0x' || substr({code}, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: "
            f"xor(c >> 8, steps[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)))")
