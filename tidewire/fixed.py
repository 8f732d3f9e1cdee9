"""Patterns, word lists, constants and codes that results depend on."""

# --- fixed values: words and patterns of the ordered filters ---
SPAM = (
    r"\b(airdrop|presale|whitelist)\b",
    r"(空投|预售|白名单|加群|私密群|收费群|信号群)",
    r"\bvip\s*(group|channel|signal|会员)\b",
    r"^(gm|gn|wagmi|ngmi|lfg|hello|hi|hey)[\s!.？?！]*$",
    r"(1000x|100x\s*gem|guaranteed\s*profit|free\s*money)",
    r"(点击链接领取|免费领币|内幕群)",
)
SPAM_MIN_LENGTH = 12
CRYPTO = (
    r"\b(bitcoin|ethereum|solana|ripple|dogecoin|cardano|polkadot)\b",
    r"\b(btc|eth|sol|xrp|bnb|usdt|usdc|dai)\b",
    r"\b(crypto|cryptocurrency|cryptocurrencies|blockchain|web3|defi|nft|nfts)\b",
    r"\b(altcoin|memecoin|stablecoin|tokenomics|airdrop)\b",
    r"\b(binance|coinbase|okx|bybit|kraken|bitfinex|huobi|gate\.io)\b",
    r"\b(metamask|opensea|uniswap|aave|chainlink)\b",
    r"(比特币|以太坊|加密货币|加密资产|数字货币|虚拟货币|区块链)",
    r"(代币|山寨币|稳定币|迷因币|狗狗币|莱特币|瑞波币)",
    r"(币安|火币|欧易|抹茶交易所|数字藏品)",
    r"(链上|链游|挖矿收益|矿工费|gas\s*费|中本聪)",
)
URGENT = "紧急降息|央行降息|导弹袭击|强震|核事故|交易暂停|熔断|emergency rate cut|missile strike|earthquake|trading halt|nuclear incident"
VICE = (
    r"(色情|黄片|裸聊|约炮|性爱视频|成人影片|做爱|口交|porn|onlyfans|\bxxx\b)",
    r"(赌博|赌场|博彩|六合彩|赌球|casino|betting)",
    r"(毒品|冰毒|海洛因|可卡因|大麻|吸毒|fentanyl|methamphetamine|\bmeth\b)",
    r"(斩首|碎尸|肢解|奸杀|血腥屠杀|gore)",
)
POLITICAL = (
    r"(习近平|李强|王沪宁|蔡奇|丁薛祥|江泽民|胡锦涛|邓小平|毛泽东|周恩来)",
    r"(总书记|党中央|中共中央|国家主席|政治局常委)",
    r"(六四|天安门事件|法轮功|藏独|疆独|台独|港独|颜色革命|颠覆国家)",
    r"(文化大革命|红卫兵|学习强国|入党宣誓)",
    r"(武统|台海开战|台海局势|武力统一)",
    r"(俄乌|乌克兰战争|哈马斯|加沙冲突|以色列空袭|北约东扩)",
)
NEWS_LIKE = r"(原油|布伦特|美伊|油价|冲突|空袭|加息|降息|美联储|战争升级|导弹袭击|地缘政治)"
NEWS_LIKE_CATEGORIES = ("能源", "地缘政治", "宏观财经", "宏观监管", "突发安全", "突发快讯", "全球新闻", "宏观快讯", "军事", "财经", "加密货币")
MESSAGE_LINK = r"https?://(?:www\.)?t\.me/\S+|t\.me/\S+"
TRUSTED_SOURCES = ("reuters", "associated press", "afp", "whitehouse.gov", "federalreserve.gov", "sec.gov")

# --- fixed values: event similarity ---
TEMPLATE_PHRASES = (
    "创下历史新高", "刷新历史新高", "创历史新高", "创近年来新高", "近年来新高", "历史新高", "再创新高", "创纪录", "零售均价", "零售价", "批发价", "均价",
    "每加仑", "每桶", "万亿美元", "亿美元", "数据显示", "根据数据", "报道称", "消息称", "部分地区", "个基点", "人民币", "美元", "基点", "加息", "降息",
    "上调", "下调", "突破", "价格", "宣布", "表示", "指出",
)
GENERIC_TOKENS = (
    "美国", "中国", "日本", "英国", "欧盟", "全球", "欧洲", "全美", "升至", "达到", "报于", "位于", "维持", "不变", "宣布", "表示", "利率", "加息", "降息",
    "基点", "上调", "下调", "个基", "将利", "率上", "央行", "行加", "行将", "储将", "储加", "突破", "价格", "均价", "美元", "以色", "色列", "公布", "劳工",
    "工部", "国劳", "部公", "同比", "the", "and", "for", "from", "with", "that", "this", "达", "至", "将", "已", "对",
)
NUMBER = r"(?:\$|usd|us\$|€|£|¥|￥)?(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
CLAUSE_MARKS = r"[。！？；;：:\n]|，(?=\S)"
JACCARD, SPECIFIC_MIN, LOOSE_JACCARD, LOOSE_SPECIFIC_MIN = 0.45, 1, 0.30, 4
WINDOW_SECONDS, EVENT_KEY_MIN_PARTS, NEW_TOKENS_MIN, LEAD_TITLE_MAX, CLAIM_SUMMARY_MAX, RECENT_MAX = 86_400, 3, 2, 40, 300, 20

# --- fixed values: evaluation records ---
BREAKING_KEYWORDS = (
    "hack", "exploit", "stolen", "vulnerability", "breach", "drain", "halt", "pause", "suspend", "sec", "fed", "doj", "arrest", "insolvent", "emergency", "breaking",
    "突发", "快讯", "黑客", "漏洞", "暂停提现", "被盗", "暴跌", "清算", "紧急", "央行", "爆炸", "战争", "重组",
)
CATEGORIES = ("科技/AI", "宏观财经", "加密货币", "军事", "地缘政治", "行业快讯", "突发安全", "宏观监管", "市场异动", "重大商业", "日常闲聊", "推广广告")
SPAM_CATEGORY, URGENT_CATEGORY, DEFAULT_CATEGORY, CHAT_CATEGORY = "推广广告", "突发安全", "行业快讯", "日常闲聊"
CRYPTO_CATEGORY = "加密货币"
DEFAULT_TITLE, DEFAULT_TAKEAWAY = "实时快讯评估简报", "密切跟踪事件后续官方动态及市场反应。"
HEURISTIC = {
    "source": "原文摘要：", "words": "触发应急告警关键词：", "fallback": "评估服务暂时不可用，系统触发启发式规则应急预警。",
    "from": "来自 @", "news": " 的突发动态", "alert": "[降级预警] ", "plain": "未分级动态: @",
}
IMPACT_MIN_SCORE, IMPACT_CATEGORIES = 9, ("军事", "地缘政治", "宏观财经")
ICONS = {"red": "alarm_outlined", "orange": "bell_outlined", "blue": "info_outlined", "grey": "cross_outlined"}

# --- fixed values: record reasons and modes ---
EXPIRED, DUPLICATE, COARSE, CRYPTO_REASON, TOPIC_REASON = "expired_or_invalid_time", "duplicate_content", "coarse_filter", "crypto_filter", "topic_filter"
DIGEST_FILTERED, DIGEST_EMPTY, EVENT_TIME, NEAR_DUPLICATE, MORNING = "digest_filtered", "digest_empty", "event_time_unknown_or_expired", "near_duplicate", "morning_processed"
NOT_PHOTO, PHOTO_UNSAFE, PHOTO_NEWS, NO_URLS, EMPTY_CAPTION, PHOTO_CAP = "not_photo_media", "wechat_unsafe", "wechat_news_like", "no_photo_urls", "empty_caption", "wechat_digest_cap"
PHOTO_VARIANT, PHOTO_TYPES, PHOTO_MAX_ITEMS, CAPTION_MAX = "wechat_photo", ("photo", "album"), 2, 100
DAY, SHOULDER, QUIET = "day", "shoulder", "quiet"
FUTURE_SLACK = 120

# --- fixed values: thresholds by mode ---
KNOBS = {
    # mode: min candidates, max wait s, min call interval s, score threshold, card gap s, candidate max age s, card cap
    "day": (3, 900, 180, 7, 10, 1800, None),
    "shoulder": (16, 900, 600, 8, 15, 1800, None),
    "quiet": (16, 900, 1800, 9, 15, 1800, 5),
    "flush": (1, 0, 0, 7, 10, 7200, None),
}
DAILY_CALLS, BATCH, PENDING_MULTIPLIER, NIGHT_ALERT_INTERVAL = 288, 20, 5, 1800
RETENTION_DAYS = {"posts": 90, "calls": 90, "night": 30}

# --- fixed values: texts of messages ---
HEADLINE, OVERVIEW, NO_OVERVIEW, UNTITLED, LITTLE_IMPACT = "本轮快讯汇总", "**📰 本轮总览**\n", "本轮暂无概述。", "未命名", "影响有限"
DIGEST_SUBTITLE, ITEM_SUBTITLE = "Telegram 批量快讯汇总", "投资情报快报"
SOURCE, FOUR_IMPACTS, FILTER_NOTE = "来源：@", "**四维影响**\n", "**🧹 过滤说明**："
IMPACT_LINES = ("**① 总体**：", "**② 美股**：", "**③ 上证**：", "**④ 大宗（黄金/原油等）**：")
IMPACT_ROWS = (("🌐 整体", "overall"), ("📈 美股", "us"), ("📊 上证", "cn"), ("🛢️ 大宗", "commodities"))
TIERS = ((9, "🚨", "特急"), (7, "⚡", "重要"), (5, "📢", "一般"), (0, "ℹ️", "低优"))
PUBLISHED, LOCAL_CLOCK, URGENCY = "🕒 **发布时间** ", "（北京时间）\n", "🎚️ **紧急** **"
CORE, NO_BULLETS, DETAIL_HEAD, INVESTMENT = "**📌 核心速览**\n", "暂无详细摘要要点", "\n📌 事件详情\n", "**💹 投资影响**"
ADVICE, DEFAULT_ADVICE = "**🎯 关注建议**\n💡 ", "紧密跟踪后续进展与官方确认信息。"
