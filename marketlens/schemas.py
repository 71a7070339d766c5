"""Fixed schemas (DDL) of the tables and payloads the operators read and write."""

NEWS_COLUMNS = ["title", "description", "content", "source", "author", "url",
                "published_at", "ticker"]
BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]

ARTICLES_PAYLOAD = (
    "articles array<struct<title string, description string, content string, "
    "source struct<name string>, author string, url string, publishedAt string>>")
COMPANY_NEWS_PAYLOAD = (
    "array<struct<headline string, summary string, source string, url string, "
    "datetime bigint>>")
QUOTE_PAYLOAD = "c double, h double, l double, o double, pc double, t bigint"
MARKET_QUOTE_PAYLOAD = (
    "regularMarketPrice double, regularMarketChange double, "
    "regularMarketChangePercent double, regularMarketVolume bigint")
DAILY_SERIES_PAYLOAD = "map<string,map<string,map<string,string>>>"

ENTITIES = "array<struct<text string, label string>>"
PREDICTION_RECORD = (
    "headline string, clean_text string, prediction string, prediction_id int, "
    "confidence double, probabilities struct<down double, neutral double, up double>, "
    "sentiment struct<polarity double, subjectivity double, compound double, "
    "positive double, negative double>, financial_keywords array<string>, "
    f"entities {ENTITIES}, model_used string")

BAR_SCHEMA = (
    "ticker string, date date, open double, high double, low double, close double, "
    "volume bigint")
