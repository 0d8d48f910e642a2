"""Addresses in networks, versions 4 and 6: equal prefixes of bits, one for each prefix length in use. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_TAIL = rf"(?:^|:)({_V4})$"


def _bits(number: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(number, base, 2), width, "0")


def _v4(address: Column) -> Column:
    return F.array_join(F.transform(F.split(address, r"\."), lambda x: _bits(x, 10, 8)), "")


def _v6(address: Column) -> Column:
    """Bits of eight groups, "::" filled up, a dotted tail as two groups; null if these aren't eight."""
    tail = F.regexp_extract(address, _TAIL, 1)
    # A dotted tail gives its place to two groups of zeros, and its bits replace theirs at the end.
    plain = F.when(tail != "", F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail)), F.lit("0:0"))).otherwise(address)
    fine = plain.rlike(r"^[0-9A-Fa-f:]+$") & ~plain.rlike(":::|[0-9A-Fa-f]{5}|::.*::|^:[^:]|[^:]:$")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    short = F.instr(plain, "::") > 0
    left = groups(F.substring_index(plain, "::", 1))
    right = F.when(short, groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    absent = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(absent, F.lit(0))), right)
    bits = F.array_join(F.transform(whole, lambda g: _bits(g, 16, 16)), "")
    mended = F.when(tail != "", F.concat(F.substring(bits, 1, 96), _v4(tail))).otherwise(bits)
    return F.when(fine & F.when(short, absent > 0).otherwise(absent == 0), mended)


def address_bits(address: Column) -> Column:
    """An address as 32 or 128 characters 0 and 1; null if it isn't one (leading zeros in octets, zones and blanks inside aren't read)."""
    return F.when(address.rlike(f"^{_V4}$"), _v4(address)).when(F.instr(address, ":") > 0, _v6(address))


def network_bits(network: Column) -> Column:
    """The bits that a network's addresses begin with; a single address is a network of its own. Lengths are numbers or, for version 4, masks of
    either kind; bits of the host are ignored. Null if it isn't a network."""
    bits = address_bits(F.substring_index(network, "/", 1))
    given = F.when(F.instr(network, "/") > 0, F.substring_index(network, "/", -1))
    mask = F.when(given.rlike(f"^{_V4}$") & (F.length(bits) == 32), _v4(given))
    by_mask = F.when(mask.rlike("^1*0*$"), F.length(F.rtrim(F.replace(mask, F.lit("0"), F.lit(" "))))).when(mask.rlike("^0*1*$"), F.length(F.rtrim(F.replace(mask, F.lit("1"), F.lit(" ")))))
    length = F.when(given.isNull(), F.length(bits)).when(given.rlike(r"^\d{1,3}$"), given.cast("int")).otherwise(by_mask)
    one_slash = F.length(network) - F.length(F.replace(network, F.lit("/"), F.lit(""))) <= 1
    return F.when(one_slash & (length <= F.length(bits)), F.substring(bits, F.lit(1), length))


def in_networks(addresses: DataFrame, address: str, networks: DataFrame, network: str) -> DataFrame:
    """Addresses with the networks that hold them, one row for each pair of rows. Blanks at the ends are cut off. An address that can't be read
    is in the entries that are written the same; an entry that can't be read holds nothing else. Null or blank addresses are in none.

    An address meets the prefix lengths in use of its version (161 at most, so they are broadcast), then networks by equal prefixes."""
    entry, asked = F.trim(network), F.trim(address)
    bits = network_bits(entry)
    version = F.when(F.length(address_bits(F.substring_index(entry, "/", 1))) == 32, 4).otherwise(6)
    read = F.when(bits.isNotNull(), F.struct(version.alias("version"), F.length(bits).alias("length"), bits.alias("start")))
    as_text = F.struct(F.lit(0).alias("version"), F.lit(0).alias("length"), entry.alias("start"))
    keyed = networks.withColumn("__n", F.explode(F.array_compact(F.array(read, as_text)))).where(F.col("__n.start").isNotNull())
    keyed = keyed.withColumns({"__version": F.col("__n.version"), "__length": F.col("__n.length"), "__start": F.col("__n.start")}).drop("__n")
    lengths = keyed.groupBy("__version").agg(F.collect_set("__length").alias("__lengths"))
    own = addresses.withColumn("__bits", address_bits(asked)).where(asked != "")
    own = own.withColumn("__version", F.when(F.col("__bits").isNull(), 0).when(F.length("__bits") == 32, 4).otherwise(6))
    spread = own.join(F.broadcast(lengths), "__version").withColumn("__length", F.explode("__lengths"))
    spread = spread.withColumn("__start", F.when(F.col("__version") == 0, asked).otherwise(F.expr("substring(__bits, 1, __length)")))
    return spread.join(keyed, ["__version", "__length", "__start"]).drop("__version", "__length", "__start", "__lengths", "__bits")
