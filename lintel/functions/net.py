"""Addresses and blocks as expressions over big integers: IPv4 as one, IPv6 as two halves, with IPv4 as its mapped part."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTETS = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
MAPPED = 0xFFFF << 32


def block(text: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network | None:
    """A block, its host bits cleared; v4 may leave out octets at the end. None if it is no block."""
    head, slash, bits = text.strip().partition("/")
    if not slash or not bits.isdigit() or not head:
        return None
    if ":" not in head:
        octets = head.split(".")
        if len(octets) > 4 or not all(re.fullmatch(r"\d{1,3}", o) for o in octets):
            return None
        head = ".".join([*octets, *["0"] * (4 - len(octets))])
    try:
        return ipaddress.ip_network(f"{head}/{bits}", strict=False)
    except ValueError:
        return None


def v4_number(address: Column) -> Column:
    """The number of an IPv4 address; null for anything else."""
    octets = F.split(address, r"\.")
    total = sum((F.get(octets, i).try_cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.get(octets, 0).try_cast("long") * (1 << 24))
    return F.when(address.rlike(OCTETS), total)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def halves(address: Column) -> Column:
    """The two halves of an IPv6 address, or of the one that an IPv4 address maps to, as hi and lo; null for anything else."""

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def plain(tail: Column) -> Column:
        """The address with its dotted end, if any, as two groups."""
        last = let(v4_number(tail), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF)))))
        return F.when(tail.contains("."), F.concat(F.left(address, F.length(address) - F.length(tail)), last)).otherwise(address)

    def whole(sides: Column) -> Column:
        both = let(F.struct(groups(F.get(sides, 0)).alias("l"), groups(F.get(sides, 1)).alias("r")), lambda x: let(8 - F.size(x.l) - F.size(x.r), lambda n: F.when(n >= 1, F.concat(x.l, F.array_repeat(F.lit("0"), F.greatest(n, F.lit(0))), x.r))))
        return F.when(F.size(sides) == 1, groups(F.get(sides, 0))).when(F.size(sides) == 2, both)

    def numbers(all_: Column) -> Column:
        number = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda n, g: F.shiftleft(n, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))
        good = (F.size(all_) == 8) & F.forall(all_, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        return F.when(good, F.struct(number(F.slice(all_, 1, 4)).alias("hi"), number(F.slice(all_, 5, 4)).alias("lo")))

    six = let(plain(F.regexp_extract(address, r":([0-9.]+)$", 1)), lambda text: let(F.split(text, "::", -1), lambda sides: let(whole(sides), numbers)))
    four = let(v4_number(address), lambda n: F.when(n.isNotNull(), F.struct(F.lit(0).cast("long").alias("hi"), n.bitwiseOR(F.lit(MAPPED)).alias("lo"))))
    return F.when(address.contains(":"), six).otherwise(four)


def number_v4(number: Column) -> Column:
    octets = [F.shiftright(number, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(number.between(0, 2**32 - 1), F.concat_ws(".", *octets))


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def within(number: Column, net) -> Column:
    """Whether halves are in a block, which for IPv4 is that of its mapped addresses."""
    size, base = (net.prefixlen + 96, MAPPED | int(net.network_address)) if net.version == 4 else (net.prefixlen, int(net.network_address))
    mask = ((1 << 128) - 1) ^ ((1 << 128 - size) - 1)
    out = F.lit(True)
    for name, shift in (("hi", 64), ("lo", 0)):
        own, of = (signed(x >> shift & ((1 << 64) - 1)) for x in (mask, base))
        out = out & (number.getField(name).bitwiseAND(F.lit(own).cast("long")) == F.lit(of).cast("long"))
    return out


def in_block(address: Column, text: str | None) -> Column:
    """Whether an address is in a literal block; null for what is no address or block. IPv4 rows need one mask."""
    net = block(text) if text is not None else None
    if net is None:
        return F.lit(None).cast("boolean")
    six = let(halves(address), lambda n: within(n, net))
    if net.version == 6:
        return six
    return F.when(address.contains(":"), six).otherwise(v4_number(address).bitwiseAND(F.lit(int(net.netmask)).cast("long")) == int(net.network_address))


def in_any(address: Column, texts: list[str | None]) -> Column:
    """Whether an address is in one of literal blocks: it is read once, and blocks that touch are one."""
    nets = [n for n in (block(t) for t in texts if t is not None) if n is not None]
    nets = [n for version in (4, 6) for n in ipaddress.collapse_addresses([x for x in nets if x.version == version])]
    hit = F.lit(False)

    def any_of(number: Column) -> Column:
        out = hit
        for net in nets:
            out = out | within(number, net)
        return F.coalesce(out, hit)

    return F.when(address.isNotNull(), let(halves(address), any_of))


def block_halves(text: Column) -> tuple[Column, Column]:
    """(halves of a block's address, its bits among 128) of text such as 10/8 or fe80::/10; null for what is none."""
    head, bits = F.regexp_extract(text, r"^\s*([^/\s]+)/\d+\s*$", 1), F.regexp_extract(text, r"^\s*[^/\s]+/(\d+)\s*$", 1).try_cast("int")
    v4 = ~head.contains(":")
    dotted = F.concat(head, F.array_join(F.array_repeat(F.lit(".0"), F.greatest(4 - F.size(F.split(head, r"\.")), F.lit(0))), ""))
    good = F.when(v4, bits <= 32).otherwise(bits <= 128)
    return halves(F.when(v4, dotted).otherwise(head)), F.when(good, F.when(v4, bits + 96).otherwise(bits))


def masked(number: Column, bits: Column) -> Column:
    """Halves with all but the leading bits cleared."""
    ones = F.lit(-1).cast("long")
    mask = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, ones).otherwise(F.call_function("shiftleft", ones, (64 - n).cast("int")))
    return F.when(bits.isNotNull() & number.isNotNull(), F.struct(number.getField("hi").bitwiseAND(mask(bits)).alias("hi"), number.getField("lo").bitwiseAND(mask(bits - 64)).alias("lo")))


def in_block_of(address: Column, text: Column) -> Column:
    """Blocks that are not literal."""
    base, bits = block_halves(text)
    return let(F.struct(halves(address).alias("a"), base.alias("b"), bits.alias("n")), lambda x: F.when(x.a.isNotNull() & x.b.isNotNull() & x.n.isNotNull(), masked(x.a, x.n) == masked(x.b, x.n)))


def in_listed(df: DataFrame, address: str, blocks: DataFrame, block_column: str, name: str = "listed") -> DataFrame:
    """df and, under name, whether the address is in one of any number of blocks: null for what is no address.

    A join on equal leading bits, once for each size of block that occurs, of which there are 129
    at most; a small list is broadcast by Spark on its measured size.
    """
    base, bits = block_halves(F.col(block_column))
    known = blocks.select(base.alias("_own"), bits.alias("_bits")).select(masked(F.col("_own"), F.col("_bits")).alias("_base"), "_bits").filter("_base is not null").distinct()
    sizes = sorted(r[0] for r in known.select("_bits").distinct().collect())
    own = df.select(F.col(address).alias("_address")).distinct().withColumn("_number", halves(F.col("_address"))).filter("_number is not null")
    each = own.select("_address", "_number", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("_bits"))
    hits = each.select("_address", "_bits", masked(F.col("_number"), F.col("_bits")).alias("_base")).join(known, ["_bits", "_base"], "left_semi").select("_address").distinct().withColumn("_hit", F.lit(True))
    found = df.join(hits, df[address] == hits["_address"], "left")
    return found.select(*(df[c] for c in df.columns), F.when(F.col("_hit"), True).when(halves(df[address]).isNotNull(), False).alias(name))
