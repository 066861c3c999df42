"""The word lists, weights, colours and limits that decide results.

Nothing here is logic; every entry has to equal the documented value for a query
to return the documented rows.
"""

# --- index and query limits (fixed values) ---------------------------------
TITLE_CHARS = 300
CONTENT_CHARS = 20000
URL_CHARS = 800
SUMMARY_CHARS = 500
XML_SUMMARY_CHARS = 200
ZH_TOKEN_CHARS = 1000
EN_TOKEN_CHARS = 2000
CATEGORY_CHARS = 1000
MIN_CONTENT_CHARS = 60
WINDOW_HOURS = 48
LOG_DAYS = 7
FEED_ITEMS = 20
PAGE_CAP = 50
QUERY_TERMS = 5
TOPIC_COUNT = 10
TOPIC_ZH_SEATS = 6

TITLE_PATH = "/news/title"
CONTENT_PATH = "/news/content"
COUNTRY_PATH = "/news/metadata/country"
TITLE_WEIGHT = 2.0
CONTENT_WEIGHT = 1.0
COUNTRY_WEIGHT = 1.5
BUILD_METHOD = "json_batch_with_country"

# --- English stop words (fixed values) -------------------------------------
EN_STOPWORDS = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she
or an will my one all would there their what so up out if about who get which go me when make can like time no
just him know take people into year your good some could them see other than then now look only come its over
think also back after use two how our work first well way even new want because any these give day most us is
was are were been has had did does doing done
""".split()

# --- Chinese stop words of the bigram tokeniser (fixed values) -------------
ZH_STOPWORDS = """
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 这些 那些 这个 那个
之 与 及 或 但 而 然而 因为 所以 因此 如果 即使 虽然 尽管 如此 便 由 被 把 给 让 向 往 自 从 关于 对于 为了 为着
除 除了 除去 凭着 根据 按照 通过 经过 随着 作为 如同 好像 一样 似的 似乎 一般 一样地 般地
""".split()

# --- Chinese stop words that end a topic chunk (fixed values) --------------
ZH_CHUNK_STOPWORDS = """
的 了 和 是 在 我 有 不 人 都 也 很 到 说 要 去 你 会 着 看 好 自己 这 那 这些 那些 这个 那个 之 与 及 或 但 而
因为 所以 因此 如果 即使 虽然 尽管 由 被 把 给 让 向 往 自 从 对 关于 对于 为了 通过 作为 随着 根据 由于 但是
并且 同时 其中 其他 相关 一个 一些 此时 此前 之后 后来 近日 日前 目前 现在 当时 当场 即将 将要 曾经 一度 一直
不断 逐渐 进一步 继续 持续 保持 进行 表示 认为 已经 开始 今年 去年 正在 成为 需要 可以 没有 年 月 日 时 分 秒
一 二 三 四 五 六 七 八 九 十 们 它 他 她 地 得 下 上 中 里 内 外 间 边 面 头 部 家 个 种 类 第 每 各 整 等 多 大
小 高 低 长 短 来 出 起 过 回 开 放 做 打 吃 走 跑
""".split()

# --- phrases without meaning (fixed values) --------------------------------
FRAGMENT_PHRASES = ["归母净", "母净利", "归母利", "母净利润", "同比增", "比增长", "环比增"]
MEANINGLESS_PATTERNS = [
    "^[母归归母母净净利利润润母净归母归母净归母利润母净利润]+$",
    "^[同比比增增长长同比增比增长]+$",
    "^..$",
    "^第[一二三四五六七八九十]+$",
    "^[上下左右前后内外]+$",
]

# --- category keywords, per category code (fixed values) -------------------
CATEGORY_KEYWORDS = {
    "tech": [
        "学术", "人工智能", "芯片", "OpenAI", "science", "科学家", "机器人", "航天", "量子", "中科院", "aerospace", "天文", "算力", "大模型",
        "academic", "科研",
    ],
    "politics": [
        "政治", "politic", "diplomacy", "Parliament", "人大", "政协", "联合国", "决议", "UN", "election", "游行", "法律", "总理",
        "chancellor", "社会", "民意", "society", "总统", "parade", "Senate", "议会", "议员", "党",
    ],
    "economy": [
        "经济", "economy", "金融", "财政", "finance", "外贸", "股票", "GDP", "物价", "上市", "市值", "CPI", "A股", "美股", "央行",
        "trade", "stock", "市场", "融资", "国债", "debt", "通胀", "inflation", "USD", "破产", "投资", "净利润", "供应链", "企业",
        "enterprise",
    ],
    "military": [
        "军事", "military", "武器", "war", "航母", "战机", "conflict", "战争", "核武器", "国防部", "airstrike", "空袭", "陆军", "海军",
        "轰炸", "潜艇", "导弹", "missile", "袭击", "submarine", "空军", "海军陆战队", "Navy", "battleship", "军费", "征兵", "军事基地",
        "军队",
    ],
    "sports": [
        "体育", "sports", "足球", "奥运", "Olympic", "羽毛球", "游泳", "排球", "世界杯", "NBA", "乒乓球", "篮球", "网球", "田径",
        "basketball", "tennis", "World Cup",
    ],
    "culture": [
        "文化", "culture", "文旅", "节日", "电视剧", "电影", "games", "游戏", "宗教", "movie", "文学", "literature", "博物馆", "演出",
        "假期", "Museum",
    ],
}

# --- categories: name, code, colour; id and order follow the list (fixed) --
CATEGORIES = [
    ("科技", "tech", "#3498db"),
    ("政治", "politics", "#e74c3c"),
    ("经济", "economy", "#2ecc71"),
    ("军事", "military", "#9b59b6"),
    ("文化", "culture", "#f39c12"),
    ("体育", "sports", "#1abc9c"),
    ("其他", "else", "#fdff57"),
]

# --- hints that force a category (fixed values) ----------------------------
API_SOURCE_ID = 1
API_HINT_CATEGORY = {"technology": "tech", "business": "economy", "science": "tech"}
API_OTHER_CATEGORY = "else"
TECH_SOURCE_ID = 18
FALLBACK_CATEGORY = "else"

# --- source names and ids (fixed values) -----------------------------------
DEFAULT_SOURCE_ID = 1
SOURCE_IDS = {
    "NewsAPI": 1,
    "36氪": 2,
    "虎嗅网": 3,
    "RT-中文": 4,
    "FoxNews-World": 5,
    "南华早报-SCMP": 6,
    "FoxNews-Politics": 7,
    "ChinaDaily": 8,
    "NewYorker": 9,
    "凤凰网-军事": 10,
    "AP-美联社": 11,
    "经济日报": 12,
    "新华网-时政": 13,
    "CNN": 14,
    "界面新闻": 15,
    "Al Jazeera": 16,
    "环球时报": 17,
    "ScienceDaily": 18,
    "俄罗斯卫星通讯社": 19,
    "纽约时报-中文": 20,
    "纽约时报中文版": 20,
    "BBC": 21,
    "newsapi": 1,
}

# --- sources: id, name, url, type, language, reliability (fixed values) -----
SOURCES = [
    (1, "NewsAPI", None, "api", "en", 8),
    (2, "36氪", "https://36kr.com/feed", "rss", "zh", 6),
    (3, "虎嗅网", "https://rss.aishort.top/?type=huxiu", "rss", "zh", 6),
    (4, "RT-中文", "https://www.rt.com/rss/news/", "rss", "zh", 7),
    (5, "FoxNews-World", "http://feeds.foxnews.com/foxnews/world", "rss", "en", 7),
    (6, "南华早报-SCMP", "https://feedx.net/rss/scmp.xml", "rss", "en", 7),
    (7, "FoxNews-Politics", "http://feeds.foxnews.com/foxnews/politics", "rss", "en", 7),
    (8, "ChinaDaily", "https://feedx.net/rss/chinadaily.xml", "rss", "en", 7),
    (9, "NewYorker", "https://feedx.net/rss/newyorker.xml", "rss", "en", 8),
    (10, "凤凰网-军事", "https://feedx.net/rss/ifengmil.xml", "rss", "zh", 6),
    (11, "AP-美联社", "https://feedx.net/rss/ap.xml", "rss", "en", 9),
    (12, "经济日报", "https://feedx.net/rss/jingjiribao.xml", "rss", "zh", 7),
    (13, "新华网-时政", "http://www.xinhuanet.com/politics/", "crawler", "zh", 9),
    (14, "CNN", "https://edition.cnn.com/world", "crawler", "en", 8),
    (15, "界面新闻", "https://www.jiemian.com/lists/4.html", "crawler", "zh", 7),
    (16, "Al Jazeera", "https://www.aljazeera.com/", "crawler", "en", 8),
    (17, "环球时报", "https://www.globaltimes.cn/", "crawler", "zh", 7),
    (18, "ScienceDaily", "https://www.sciencedaily.com/news/", "crawler", "en", 8),
    (19, "俄罗斯卫星通讯社", "https://sputniknews.cn/", "crawler", "zh", 7),
    (20, "纽约时报中文版", "https://cn.nytimes.com/", "crawler", "zh", 8),
    (21, "BBC", "https://www.bbc.com/news", "crawler", "en", 8),
]

# --- feeds: name, language, category hint, country hint (fixed values) ------
FEEDS = [
    ("36氪", "zh", "tech", None),
    ("虎嗅网", "zh", "tech", None),
    ("RT-中文", "en", "international", None),
    ("FoxNews-World", "en", "international", "US"),
    ("南华早报-SCMP", "en", "international", "HK"),
    ("FoxNews-Politics", "en", "politics", "US"),
    ("ChinaDaily", "en", "international", None),
    ("NewYorker", "en", "culture", None),
    ("凤凰网-军事", "zh", "military", "CN"),
    ("AP-美联社", "en", "international", "US"),
    ("经济日报", "zh", "business", "CN"),
]
FEED_DEFAULT_CATEGORY = "general"

# --- badges, colours, default texts (fixed values) --------------------------
SOURCE_TYPE_COLOURS = {"rss": "#3498db", "api": "#2ecc71", "crawler": "#e74c3c"}
RELIABILITY_COLOURS = [(9, "#27ae60"), (7, "#2ecc71"), (5, "#f39c12")]
LOW_RELIABILITY_COLOUR = "#e74c3c"
DEFAULT_RELIABILITY = 5
HEAT_STOPS = [(46, 204, 113), (241, 196, 15), (230, 126, 34), (231, 76, 60)]
UNTITLED = "无标题"
UNKNOWN_SOURCE = "未知来源"
API_SOURCE = "NewsAPI"

# --- the twenty countries listed first (fixed values) -----------------------
TOP_COUNTRIES = "CN US JP GB RU IN DE FR BR CA AU KR IT ES MX ID TR SA ZA EG".split()

# --- address parts that mark an image or iframe as furniture (fixed) --------
IMAGE_SKIP = [
    "qrcode", "qr-code", "detail", "icon", "logo", "avatar", "button", "share", "wechat", "weibo", "facebook",
    "twitter", "svg", "gif", "advertisement", "ad-", "_ad_", "tracking", "pixel", "spacer", "blank", "placeholder",
    "loading", "loading-icon",
]
PLACEHOLDER_PARTS = [
    "static.files.bbci.co.uk", "news.files.bbci.co.uk", "grey-placeholder", "placeholder", "icon", "logo", "avatar",
    "1x1", "pixel", "transparent", "spacer", "blank.gif", "empty.gif", ".svg",
]
TRACKER_PARTS = [
    "googletagmanager.com", "google-analytics.com", "doubleclick.net", "googleadservices.com", "facebook.com/tr/",
    "connect.facebook.net", "bat.bing.com", "tags.tiqcdn.com", "analytics", "tracker", "pixel", "gtm-", "gtag",
    "scribe.", "heatmap", "optimizely", "hotjar",
]
PAYWALL_SIGNS = ["sign in", "subscribe", "login", "access denied"]
AD_TEXTS = ["advertisement", "ad feedback", "cnn sans"]
EDITOR_LINE_ENDS = ["纠错", "编辑：", "责任编辑"]
BLOCK_END_MARKS = [":", "：", "；", ";"]
