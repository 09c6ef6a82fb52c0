"""Fixed reference tables: exchanges, the codes that lists use for them, names of countries."""

from __future__ import annotations

#: Market identifier, name, country, currency and the codes that listings use.
EXCHANGES = (
    ("XNAS", "NASDAQ", "US", "USD", ("NMS", "NGM", "NCM", "NAS", "XNAS",)),
    ("XNYS", "NYSE", "US", "USD", ("NYQ", "NYS", "XNYS",)),
    ("XASE", "NYSE American", "US", "USD", ("ASE", "XASE",)),
    ("ARCX", "NYSE Arca", "US", "USD", ("PCX", "ARCX",)),
    ("BATS", "Cboe BZX", "US", "USD", ("BATS",)),
    ("IEXG", "Investors Exchange", "US", "USD", ("IEX",)),
    ("OTCM", "OTC Markets / Pink", "US", "USD", ("PNK", "OTC",)),
    ("XTSE", "Toronto Stock Exchange", "CA", "CAD", ("TOR", "TSE", "TSX",)),
    ("XTSX", "TSX Venture Exchange", "CA", "CAD", ("VAN",)),
    ("XLON", "London Stock Exchange", "GB", "GBP", ("LSE",)),
    ("XFRA", "Deutsche Börse Frankfurt", "DE", "EUR", ("FRA",)),
    ("XSTU", "Stuttgart Stock Exchange", "DE", "EUR", ("STU",)),
    ("XBER", "Berlin Stock Exchange", "DE", "EUR", ("BER",)),
    ("XMUN", "Munich Stock Exchange", "DE", "EUR", ("MUN",)),
    ("XDUS", "Düsseldorf Stock Exchange", "DE", "EUR", ("DUS",)),
    ("XHAM", "Hamburg Stock Exchange", "DE", "EUR", ("HAM",)),
    ("XETR", "Xetra", "DE", "EUR", ("GER",)),
    ("XWBO", "Wiener Börse", "AT", "EUR", ("VIE",)),
    ("XSWX", "SIX Swiss Exchange", "CH", "CHF", ("EBS", "SWX",)),
    ("XVTX", "SIX Swiss Exchange (Virt-X)", "CH", "CHF", ("VTX",)),
    ("XPAR", "Euronext Paris", "FR", "EUR", ("PAR",)),
    ("XMIL", "Borsa Italiana", "IT", "EUR", ("MIL",)),
    ("XMAD", "Bolsa de Madrid", "ES", "EUR", ("MCE",)),
    ("XCSE", "Copenhagen Stock Exchange", "DK", "DKK", ("CSE",)),
    ("XSTO", "Nasdaq Stockholm", "SE", "SEK", ("STO",)),
    ("XHEL", "Nasdaq Helsinki", "FI", "EUR", ("HEL",)),
    ("XICE", "Nasdaq Iceland", "IS", "ISK", ("ICE",)),
    ("XOSL", "Oslo Børs", "NO", "NOK", ("OSL",)),
    ("XTKS", "Tokyo Stock Exchange", "JP", "JPY", ("JPX", "TKS", "TKO", "TSE",)),
    ("XOSE", "Osaka Exchange", "JP", "JPY", ("OSE",)),
    ("XNGO", "Nagoya Stock Exchange", "JP", "JPY", ("NGO",)),
    ("XBOM", "BSE India", "IN", "INR", ("BSE",)),
    ("XNSE", "National Stock Exchange of India", "IN", "INR", ("NSE",)),
    ("XHKG", "Hong Kong Stock Exchange", "HK", "HKD", ("HKG",)),
    ("XSHE", "Shenzhen Stock Exchange", "CN", "CNY", ("SHZ", "SHE",)),
    ("XSHG", "Shanghai Stock Exchange", "CN", "CNY", ("SHH", "SHG",)),
    ("XKOS", "KOSDAQ", "KR", "KRW", ("KSC", "KOS",)),
    ("XKRX", "Korea Exchange", "KR", "KRW", ("KOE",)),
    ("XASX", "ASX", "AU", "AUD", ("ASX",)),
    ("XNZE", "NZX", "NZ", "NZD", ("NZX",)),
    ("XSES", "Singapore Exchange", "SG", "SGD", ("SGX", "SES",)),
    ("XBKK", "Stock Exchange of Thailand", "TH", "THB", ("SET",)),
    ("XJSE", "Johannesburg Stock Exchange", "ZA", "ZAR", ("JNB",)),
    ("XMEX", "Bolsa Mexicana de Valores", "MX", "MXN", ("MEX",)),
    ("BVMF", "B3 - Brasil Bolsa Balcão", "BR", "BRL", ("SAO",)),
    ("XIST", "Borsa Istanbul", "TR", "TRY", ("IST",)),
    ("XPHS", "Philippine Stock Exchange", "PH", "PHP", ("PSE",)),
    ("XTAI", "Taiwan Stock Exchange", "TW", "TWD", ("TAI",)),
    ("ROCO", "Taipei Exchange (OTC)", "TW", "TWD", ("TWO",)),
    ("XBCBA", "Buenos Aires Stock Exchange", "AR", "ARS", ("BUE",)),
    ("AQSE", "Aquis Stock Exchange", "GB", "GBP", ("AQS",)),
    ("MOEX", "Moscow Exchange", "RU", "RUB", ("MCX",)),
    ("XCAI", "Cairo Exchange", "EG", "EGP", ("CAI",)),
    ("XAMS", "Euronext Amsterdam", "NL", "EUR", ("AMS",)),
    ("XBRU", "Euronext Brussels", "BE", "EUR", ("BRU",)),
    ("XATH", "Athens Stock Exchange", "GR", "EUR", ("ATH",)),
    ("XSAU", "Saudi Exchange (Tadawul)", "SA", "SAR", ("SAU",)),
    ("XLIS", "Euronext Lisbon", "PT", "EUR", ("LIS",)),
    ("XCAS", "Casablanca Stock Exchange", "MA", "MAD", ("CCS",)),
    ("XQAT", "Qatar Stock Exchange", "QA", "QAR", ("DOH",)),
    ("XBUD", "Budapest Stock Exchange", "HU", "HUF", ("BUD",)),
    ("XPRA", "Prague Stock Exchange", "CZ", "CZK", ("PRA",)),
    ("XDUB", "Euronext Dublin (Irish Stock Exchange)", "IE", "EUR", ("ISE",)),
    ("NEOE", "NEO Exchange", "CA", "CAD", ("NEO",)),
    ("XLIT", "Cboe Europe LIT", "GB", "GBP", ("LIT",)),
    ("XRIS", "Nasdaq Riga", "LV", "EUR", ("RIS",)),
    ("XTAL", "Nasdaq Tallinn", "EE", "EUR", ("TAL", "TLO",)),
    ("XBTS", "Bratislava Stock Exchange", "SK", "EUR", ("BTS",)),
    ("XNSA", "Nigerian Exchange", "NG", "NGN", ("NSI",)),
    ("XNAM", "Namibian Stock Exchange", "NA", "NAD", ("NAE",)),
)

#: Exchange codes of listed shares and their market; of two readings of a code (TSE) the later use holds.
EXCHANGE_MIC = {
    "NMS": "XNAS", "NGM": "XNAS", "NCM": "XNAS", "NAS": "XNAS", "NYQ": "XNYS", "NYS": "XNYS", "ASE": "XASE", "PCX": "ARCX", "IEX": "IEXG",
    "PNK": "OTCM", "OTC": "OTCM", "TOR": "XTSE", "TSE": "XTKS", "VAN": "XTSX", "TSX": "XTSE", "LSE": "XLON", "FRA": "XFRA", "STU": "XSTU",
    "BER": "XBER", "MUN": "XMUN", "DUS": "XDUS", "HAM": "XHAM", "GER": "XETR", "VIE": "XWBO", "EBS": "XSWX", "SWX": "XSWX", "VTX": "XVTX",
    "PAR": "XPAR", "MIL": "XMIL", "MCE": "XMAD", "CSE": "XCSE", "STO": "XSTO", "HEL": "XHEL", "ICE": "XICE", "OSL": "XOSL", "JPX": "XTKS",
    "TKS": "XTKS", "TKO": "XTKS", "OSE": "XOSE", "NGO": "XNGO", "NSE": "XNSE", "BSE": "XBOM", "HKG": "XHKG", "SHZ": "XSHE", "SHE": "XSHE",
    "SHH": "XSHG", "SHG": "XSHG", "KSC": "XKOS", "KOS": "XKOS", "KOE": "XKRX", "ASX": "XASX", "NZX": "XNZE", "SGX": "XSES", "TWO": "ROCO",
    "TAI": "XTAI", "PSE": "XPHS", "SET": "XBKK", "SAO": "BVMF", "MEX": "XMEX", "JNB": "XJSE", "IST": "XIST", "HAN": "XHAN", "KLS": "XKLS",
    "IOB": "IOBA", "JKT": "XIDX", "CPH": "XCSE", "TLO": "XTAL", "SGO": "XSGO", "CNQ": "XNCA", "SES": "XSES", "TLV": "XTAE", "BUE": "XBCBA",
    "AQS": "AQSE", "NZE": "XNZE", "MCX": "MOEX", "CAI": "XCAI", "AMS": "XAMS", "BRU": "XBRU", "ATH": "XATH", "SAU": "XSAU", "LIS": "XLIS",
    "CCS": "XCAS", "DOH": "XQAT", "BUD": "XBUD", "PRA": "XPRA", "ISE": "XDUB", "FKA": "XFRA", "NEO": "NEOE", "LIT": "XLIT", "RIS": "XRIS",
    "TAL": "XTAL", "SAP": "XSAU", "ENX": "XAMS", "BTS": "XBTS", "NSI": "XNSA", "SAT": "XSAU", "NAE": "XNAM", "OBB": "XTAL",
}
#: Markets that may stand for themselves where a code is expected.
OWN_CODE = (
    "XASE", "ARCX", "BATS", "XKRX", "XKOS", "XHKG", "XTAI", "ROCO", "XTSE", "XTSX", "NEOE", "XLON", "XPAR", "XFRA", "XBER", "XDUS", "XMUN", "XHAM",
    "XSES", "XMIL", "XAMS", "XBRU", "XWBO", "XLIS", "XDUB", "XHEL", "XCSE", "XTKS", "XKLS", "XSHG", "XASX", "XNZE", "BVMF",
)

#: Names of countries that the ISO list does not have in this form, or has; the ISO list itself is a parameter.
COUNTRY_NAMES = {
    "united states": "us", "united states of america": "us", "usa": "us", "us": "us", "canada": "ca", "china": "cn", "hong kong": "hk",
    "south korea": "kr", "korea, south": "kr", "korea": "kr", "japan": "jp", "united kingdom": "gb", "uk": "gb", "france": "fr", "germany": "de",
    "australia": "au", "india": "in", "thailand": "th", "taiwan": "tw", "sweden": "se", "brazil": "br", "singapore": "sg", "italy": "it",
    "israel": "il", "norway": "no", "spain": "es", "netherlands": "nl", "switzerland": "ch", "denmark": "dk", "ireland": "ie", "poland": "pl",
    "mexico": "mx", "austria": "at", "russia": "ru", "bahrain": "bh",
}


def exchange_codes() -> dict[str, str]:
    """Code to market, with the markets that stand for themselves."""
    return EXCHANGE_MIC | {m: m for m in OWN_CODE}


def market_countries() -> dict[str, str]:
    """Market to ISO country code in small letters."""
    return {mic: country.lower() for mic, _, country, _, _ in EXCHANGES}


def country_codes(iso: dict[str, str] | None = None) -> dict[str, str]:
    """Country name in small letters to ISO code in small letters; ``iso`` (name or code to code) comes first."""
    return COUNTRY_NAMES | {name.lower(): code.lower() for name, code in (iso or {}).items()}
