"""Names by which instruments are called, as text in natural order."""

from __future__ import annotations

# ---- fixed values: how indices, and what trades elsewhere, are written: alias and symbol
INDEX_ALIASES = {
    "NIFTY": "NIFTY", "NIFTY50": "NIFTY", "NF": "NIFTY", "NIFTI": "NIFTY", "BANKNIFTY": "BANKNIFTY", "NIFTYBANK": "BANKNIFTY", "BNF": "BANKNIFTY",
    "BN": "BANKNIFTY", "BANKNIFTI": "BANKNIFTY", "FINNIFTY": "FINNIFTY", "FINIFTY": "FINNIFTY", "NIFTYFIN": "FINNIFTY", "MIDCPNIFTY": "MIDCPNIFTY",
    "MIDCAPNIFTY": "MIDCPNIFTY", "MIDCPNIFTI": "MIDCPNIFTY", "NIFTYMIDCAP": "MIDCPNIFTY", "MIDCAPSELECT": "MIDCPNIFTY", "MIDCP": "MIDCPNIFTY",
    "NIFTYNEXT50": "NIFTYNXT50", "NIFTYNXT50": "NIFTYNXT50", "SENSEX": "SENSEX", "BANKEX": "BANKEX", "CRUDE": "CRUDEOIL", "CRUDEOIL": "CRUDEOIL",
    "NATURALGAS": "NATURALGAS", "NATGAS": "NATURALGAS", "NG": "NATURALGAS", "GOLD": "GOLD", "GOLDM": "GOLD", "ZINC": "ZINC", "COPPER": "COPPER",
    "ALUMINIUM": "ALUMINIUM", "BITCOIN": "BITCOIN", "BTC": "BITCOIN", "BTCUSD": "BITCOIN", "ETH": "ETHEREUM", "ETHEREUM": "ETHEREUM",
    "USTEC": "NASDAQ", "NASDAQ": "NASDAQ", "NAS100": "NASDAQ", "XAUUSD": "GOLD",
}
# ---- fixed values: where an instrument outside the price data trades
OFF_EXCHANGE = {
    "SENSEX": "BSE", "BANKEX": "BSE", "CRUDEOIL": "MCX", "NATURALGAS": "MCX", "GOLD": "MCX", "ZINC": "MCX", "COPPER": "MCX", "ALUMINIUM": "MCX",
    "BITCOIN": "a crypto exchange", "ETHEREUM": "a crypto exchange", "NASDAQ": "a market outside India",
}
# ---- fixed values: how shares are written: alias and symbol
STOCK_ALIASES = {
    "RELIANCEIND": "RELIANCE", "RIL": "RELIANCE", "HDFC": "HDFCBANK", "HDFCBK": "HDFCBANK", "ICICI": "ICICIBANK", "ICICIBK": "ICICIBANK",
    "SBI": "SBIN", "STATEBANK": "SBIN", "AXIS": "AXISBANK", "AXISBK": "AXISBANK", "KOTAK": "KOTAKBANK", "KOTAKBK": "KOTAKBANK",
    "KOTAKMAHINDRA": "KOTAKBANK", "INDUSIND": "INDUSINDBK", "INDUSINDBANK": "INDUSINDBK", "BOB": "BANKBARODA", "BANKOFBARODA": "BANKBARODA",
    "CANARABANK": "CANBK", "CANARA": "CANBK", "PUNJABNATIONALBANK": "PNB", "YESBANK": "YESBANK", "IDFCFIRST": "IDFCFIRSTB",
    "IDFCFIRSTBANK": "IDFCFIRSTB", "FEDERALBANK": "FEDERALBNK", "BANDHAN": "BANDHANBNK", "BANDHANBANK": "BANDHANBNK", "AUBANK": "AUBANK",
    "INFOSYS": "INFY", "TECHMAHINDRA": "TECHM", "HCL": "HCLTECH", "LTI": "LTIM", "LTIMINDTREE": "LTIM", "LARSEN": "LT", "LNT": "LT", "L&T": "LT",
    "LARSENTOUBRO": "LT", "MAHINDRA": "M&M", "MNM": "M&M", "MARUTISUZUKI": "MARUTI", "BAJAJAUTO": "BAJAJ-AUTO", "HEROMOTO": "HEROMOTOCO",
    "HEROMOTOCORP": "HEROMOTOCO", "EICHER": "EICHERMOT", "EICHERMOTORS": "EICHERMOT", "TVS": "TVSMOTOR", "ASHOKLEYLAND": "ASHOKLEY",
    "BAJAJFINANCE": "BAJFINANCE", "BAJFIN": "BAJFINANCE", "BAJAJFINSERV": "BAJAJFINSV", "BAJAJFINSV": "BAJAJFINSV", "HUL": "HINDUNILVR",
    "HINDUNILEVER": "HINDUNILVR", "HINDUSTANUNILEVER": "HINDUNILVR", "AIRTEL": "BHARTIARTL", "BHARTIAIRTEL": "BHARTIARTL", "BHARTI": "BHARTIARTL",
    "VODAFONEIDEA": "IDEA", "VODAIDEA": "IDEA", "VI": "IDEA", "SUNPHARMA": "SUNPHARMA", "DRREDDY": "DRREDDY", "DRREDDYS": "DRREDDY",
    "DIVIS": "DIVISLAB", "ULTRATECH": "ULTRACEMCO", "ULTRATECHCEMENT": "ULTRACEMCO", "ASIANPAINTS": "ASIANPAINT", "POWERGRID": "POWERGRID",
    "COALINDIA": "COALINDIA", "VEDANTA": "VEDL", "HINDALCO": "HINDALCO", "JSW": "JSWSTEEL", "JINDALSTEEL": "JINDALSTEL", "HPCL": "HINDPETRO",
    "HINDPETRO": "HINDPETRO", "INDIANOIL": "IOC", "LIC": "LICI", "ZOMATO": "ZOMATO", "POLICYBAZAAR": "POLICYBZR", "PBFINTECH": "POLICYBZR",
    "JIOFINANCIAL": "JIOFIN", "JIOFINANCE": "JIOFIN", "ADANIENTERPRISES": "ADANIENT", "ADANIPORT": "ADANIPORTS", "ADANIGREENENERGY": "ADANIGREEN",
    "TATACONSUMER": "TATACONSUM", "TATACOMMUNICATIONS": "TATACOMM", "TATACHEMICALS": "TATACHEM", "TATAELXSI": "TATAELXSI", "INDIGO": "INDIGO",
    "INTERGLOBE": "INDIGO", "HINDUSTANAERONAUTICS": "HAL", "BHARATELECTRONICS": "BEL", "MAZAGON": "MAZDOCK", "MAZAGONDOCK": "MAZDOCK",
    "COCHINSHIPYARD": "COCHINSHIP", "GARDENREACH": "GRSE", "SUZLONENERGY": "SUZLON", "ANGELONE": "ANGELONE", "MOTHERSON": "MOTHERSON",
    "SAMVARDHANA": "MOTHERSON", "DMART": "DMART", "AVENUESUPERMARTS": "DMART", "PIDILITE": "PIDILITIND", "HAVELLS": "HAVELLS",
    "GODREJCONSUMER": "GODREJCP", "GODREJPROPERTIES": "GODREJPROP", "APOLLOHOSPITAL": "APOLLOHOSP", "APOLLOHOSPITALS": "APOLLOHOSP",
    "MUTHOOT": "MUTHOOTFIN", "CHOLA": "CHOLAFIN", "SHRIRAMFINANCE": "SHRIRAMFIN", "PERSISTENT": "PERSISTENT", "BHARATFORGE": "BHARATFORG",
    "AMBUJA": "AMBUJACEM", "AMBUJACEMENT": "AMBUJACEM", "NATIONALALUMINIUM": "NATIONALUM", "NALCO": "NATIONALUM", "HINDCOPPER": "HINDCOPPER",
    "HINDUSTANCOPPER": "HINDCOPPER", "HINDZINC": "HINDZINC", "HINDUSTANZINC": "HINDZINC", "UNITEDSPIRITS": "UNITDSPR", "MCDOWELL": "UNITDSPR",
    "IEX": "IEX", "NYKAA": "NYKAA", "MOTHERSUMI": "MOTHERSON", "HEROMOTORS": "HEROMOTOCO", "TVSMOTORS": "TVSMOTOR", "TVSMOTOR": "TVSMOTOR",
    "LICHOUSING": "LICHSGFIN", "LICHSGFIN": "LICHSGFIN", "LICHSG": "LICHSGFIN", "MOTILALOSWAL": "MOTILALOFS", "MOTILAL": "MOTILALOFS",
    "SILVERBEES": "SILVERBEES", "GOLDBEES": "GOLDBEES", "NIFTYBEES": "NIFTYBEES", "BANKBEES": "BANKBEES", "DELHIVERY": "DELHIVERY",
    "SWIGGY": "SWIGGY", "OLA": "OLAELEC", "OLAELECTRIC": "OLAELEC",
}
# ---- fixed values: a ticker that went on under another name
SUCCESSORS = {"ZOMATO": "ETERNAL", "TATAMOTORS": "TMPV"}
# ---- fixed values: tickers that are ordinary words too
WORD_TICKERS = """
IT IDEA GLOBAL PREMIUM MIDCAP SILVER ENERGY STAR MASTER MOMENTUM ACE DEN PAR OIL NH TI BI VR AVG INA SEL MAL MOL MOS SAH LAL KEN TAC TRU UMA FOCUS
BLUECHIP ORIENT DELTA SAFARI SHARE TIPS RICH MONEY TREND ELITE TOTAL VISA CASH
"""
# ---- fixed values: words of company names that do not tell companies apart
NAME_NOISE = """
LTD LIMITED LTD. INDIA INDIAN INDUSTRIES INDUSTRY IND INDS CORPORATION CORP COMPANY CO OF THE AND & PVT PRIVATE ENTERPRISES ENTERPRISE HOLDINGS GROUP
"""
FUND = r"\bAMC\b|\bETF\b|BEES\b|\bMF\b|MUTUAL\s+FUND| - "
# ---- fixed values: words around a name that are no part of it
FILLER = """
BUY BOUGHT BUYING SELL SOLD SHORT LONG ACCUMULATE ADD MORE FRESH NEW TRADE CALL CALLS ALERT OPTION OPTIONS STOCK STOCKS INTRADAY INTRA DAY TODAY TODAYS
EXPIRY WEEKLY MONTHLY FUT FUTURE FUTURES CASH EQ EQUITY NSE HERO ZERO JACKPOT RISKY SAFE TRADERS ONLY LOOKS GOOD ABOVE BELOW NEAR AT CMP LTP NOW IN ON
THE A FOR OF BTST STBT SWING POSITIONAL INDEX SPOT STRIKE PRICE SURE SHOT BIG SPECIAL FREE PAID VIP MEMBERS QUICK FAST MOMENTUM SCALP SCALPING NAME SCRIP
SCRIPT SYMBOL TIP TIPS RECOMMENDATION DELIVERY SHORTTERM TERM HOLD AGAIN ONE LOT LOTS QTY HIGH RISK LOW TARGET TGT SL ENTRY RANGE BETWEEN AROUND AND OR
TO ST ND RD TH EXP CE PE PUT PUTS IS LTD LIMITED SHARES SHARE WATCH LOOKING CAN MAY TOUCH WITH VOLUME INDIA JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC
"""


def words(text: str) -> list[str]:
    return text.split()

