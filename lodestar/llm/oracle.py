"""DuckDB SQL that several oracles of this subpackage share."""

from __future__ import annotations

#: tab, a list: the 256 values of the byte-wise CRC-32 (polynomial EDB88320).
CRC_TABLE = "crc_ as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as tab from range(256) r(i))"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, where tab of CRC_TABLE is at hand."""
    byte = f"cast('0x' || substr(hex(encode({text})), cast(2 * j + 1 as int), 2) as bigint)"
    return f"xor(4294967295, list_reduce(range(cast(length(hex(encode({text}))) // 2 as bigint)), lambda c, j: xor(c >> 8, tab[cast((xor(c, {byte}) & 255) + 1 as int)]), 4294967295))"
