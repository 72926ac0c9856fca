"""Scalar functions over symbols, names and money, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote assets that venues append, longest first, and multipliers that they put before a base.
QUOTES = ("USDT", "USDC", "BUSD", "USDD", "TUSD", "USD", "PERP")
MULTIPLIERS = ("1000000", "100000", "10000", "1000", "100", "10", "K", "M")

# Tickers of stablecoins and of wrapped assets.
STABLE_TICKERS = (
    "USDT USDC BUSD DAI TUSD USDP USDD GUSD FRAX LUSD SUSD CUSD UST MIM FEI TRIBE RAI DOLA OUSD MUSD HUSD EURS EURT EUROC XSGD BIDR FDUSD PYUSD USDJ RSV VAI CEUR JPYC XIDR IDRT BKRW BGBP XAUT PAXG USTC"
).split()
WRAPPED_TICKERS = "WBTC WETH WBNB WMATIC WAVAX WFTM WONE WCRO RENBTC HBTC BTCB TBTC SBTC OBTC BBTC STETH RETH CBETH SFRXETH WSTETH BETH ANKRETH".split()
# Parts of names that mark a derivative claim or a stablecoin, and names that only look like one.
DERIVATIVE_PARTS = ("wrapped", "staked", "restaked", "bridged", "peg", "-peg", "wormhole", "liquid staking", "lst ", "receipt", "synthetic", "tokenized")
STABLE_PARTS = ("usd", "stable", "dollar", "euro", "eur ", "tether", "gbp", "yen", "jpy", "peso", "real ", "franc", "dirham", "rupee", "lira")
ORDINARY_NAMES = ("usdt.z", "pundi x", "usual")


def normal_base(symbol: Column) -> Column:
    """Upper case, cut at ``-`` then ``_``, one quote suffix and a leading multiplier off where something remains."""
    s = F.split_part(F.split_part(F.upper(F.trim(symbol)), F.lit("-"), F.lit(1)), F.lit("_"), F.lit(1))
    out = None
    for q in QUOTES:
        hit = s.endswith(q) & (F.length(s) > len(q))
        cut = F.substr(s, F.lit(1), F.length(s) - len(q))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return F.regexp_replace(F.coalesce(out.otherwise(s), F.lit("")), f"^(?:{'|'.join(MULTIPLIERS)})(?=[A-Z0-9]{{2,}})", "")


def is_pegged(symbol: Column, name: Column) -> Column:
    """Whether a token is a claim on another or a stablecoin: by ticker, then by its name unless that is ordinary."""
    ticker, title = F.upper(F.trim(F.coalesce(symbol, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    has = lambda parts: F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(title, p))
    return F.when(ticker.isin(*STABLE_TICKERS, *WRAPPED_TICKERS), True).when(has(ORDINARY_NAMES), False).otherwise(has(DERIVATIVE_PARTS + STABLE_PARTS))


def money(v: Column) -> Column:
    """``1.2T``, ``3.4B``, ``5.6M``, ``7.8k`` or the plain amount."""
    out = None
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "k")):
        text = F.concat(F.format_string("%.1f", v / size), F.lit(unit))
        out = F.when(v >= size, text) if out is None else out.when(v >= size, text)
    return out.when(v.isNotNull(), F.format_string("%.0f", v))


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, f"{suffix}$", "")


def number(c: Column) -> Column:
    """A double, or null for text that is none."""
    return F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")


def month_grid(date: Column, every: int) -> Column:
    """Whether the date is on a grid of so many days since 1970-01-01."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")) % every == 0
