"""Membership of addresses in networks: IPv4 by arithmetic in the plan, IPv6 by a vectorised function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"\A{OCTET}(\.{OCTET}){{3}}\z"


def network(text: str):
    """The network of a literal; host bits are masked off. Raises ValueError."""
    if "/" not in text:
        raise ValueError(f"no prefix length: {text}")
    address, length = text.split("/", 1)
    if not length.isascii() or not length.isdigit():
        raise ValueError(f"prefix length: {text}")
    return ipaddress.ip_network(f"{ipaddress.ip_address(address)}/{int(length)}", strict=False)


def in_network(text: Column, literal: str) -> Column:
    """Null-free: false for anything that is no address of the network's own family."""
    net = network(literal)
    if net.version == 4:
        octets = F.split(F.when(text.rlike(DOTTED), text), r"\.")
        value = sum((octets[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), octets[0].cast("long") * (1 << 24))
        return F.coalesce(value.bitwiseAND(F.lit(int(net.netmask))) == F.lit(int(net.network_address)), F.lit(False))

    @F.pandas_udf("boolean")
    def inside(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                a = ipaddress.IPv6Address(t)
            except ValueError:
                return False
            return a.scope_id is None and a in net

        return texts.map(one, na_action="ignore").fillna(False).astype(bool)

    return F.coalesce(F.when(text.contains(":"), inside(text)), F.lit(False))
