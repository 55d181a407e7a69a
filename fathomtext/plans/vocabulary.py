"""Vocabularies, literals and rule parameters of the report corpus.

Fixed values: results are only right if these equal the corpus's own conventions.
"""

# --- report layout -----------------------------------------------------------------------------
BUSINESS = "## 業務簡介"
SUPPLY_CHAIN = "## 供應鏈位置"
CUSTOMERS = "## 主要客戶及供應商"
FINANCIALS = "## 財務概況"
SECTIONS = [BUSINESS, SUPPLY_CHAIN, CUSTOMERS, FINANCIALS]
METADATA = ["板塊:", "產業:", "市值:", "企業價值:"]
NOT_FILLED = "(待更新)"
FINANCIAL_TITLE = "## 財務概況 (單位: 百萬台幣, 只有 Margin 為 %)"
VALUATION_TITLE = "### 估值指標"
ANNUAL_TITLE = "### 年度關鍵財務數據 (近 3 年)"
QUARTERLY_TITLE = "### 季度關鍵財務數據 (近 4 季)"
NO_DATA = "無可用數據。"
UNIT = "百萬台幣"
TO_ENRICH = "*(待enrichment)*"
TO_ENRICH_BUSINESS = "*(待enrichment — 請使用 /update-enrichment 補充業務描述)*"

# --- quality rules -----------------------------------------------------------------------------
MIN_CHARS, MIN_LINKS, ENGLISH_LINES, MIN_CHAIN_LINES, MIN_CUSTOMER_LINES = 200, 8, 20, 3, 4
GENERIC_MARKERS = [
    "大廠", "供應商", "客戶", "廠商", "原廠", "經銷商", "製造商", "業者", "企業", "公司", "代理商", "品牌商",
    "營運商", "貿易商", "通路商", "零售商", "承包商", "開發商", "服務商", "整合商",
]
PLACEHOLDERS = ["待 AI 補充", "待 [[AI]] 補充", "(待更新)", "基於嚴格實名制", "待enrichment"]
ENGLISH_INDICATORS = [
    "Business Description", "Inc.", "Ltd.", "manufactures", "provides", "is a company", "headquartered",
    "was founded", "specializes in", "engages in", "operates through",
]

# --- entity categories -------------------------------------------------------------------------
TECH_TERMS = [
    "AI", "PCB", "5G", "HBM", "CoWoS", "InFO", "EUV", "CPO", "FOPLP", "VCSEL", "EML", "MLCC", "MOSFET", "IGBT",
    "DRAM", "NAND", "SSD", "DDR5", "DDR4", "PCIe", "USB", "WiFi", "Bluetooth", "OLED", "AMOLED", "Mini LED",
    "Micro LED", "MCU", "SoC", "ASIC", "FPGA", "RF", "IC", "LED", "LCD", "TFT", "CMP", "CVD", "PVD", "ALD", "AOI",
    "SMT", "BGA", "QFN", "SOP", "ABF 載板", "BT 載板", "ABF", "SerDes", "PMIC", "LDO", "NOR Flash", "NAND Flash",
    "矽光子", "光收發模組",
]
INDEX_ONLY_TECH_TERMS = [
    "TSV", "RDL", "WLCSP", "FC-BGA", "FCCSP", "eMMC", "UFS", "MEMS", "CIS", "ToF", "LiDAR", "磊晶", "蝕刻", "微影",
    "封裝測試", "晶圓代工", "2.5D 封裝", "3D 封裝",
]
MATERIAL_TERMS = [
    "碳化矽", "氮化鎵", "磷化銦", "砷化鎵", "矽晶圓", "銅箔", "玻纖布", "光阻液", "研磨液", "超純水", "氦氣", "氖氣",
    "鈦酸鋇", "聚醯亞胺", "導線架", "探針卡", "BT 樹脂", "銀漿", "銅漿", "氧化鋁",
]
APPLICATION_TERMS = [
    "AI 伺服器", "電動車", "物聯網", "資料中心", "低軌衛星", "5G", "智慧家庭", "車用電子", "消費電子", "綠能", "太陽能",
    "風電", "儲能系統", "離岸風電", "自動駕駛", "智慧城市", "行車記錄器", "無人機",
]
CATEGORY_COLORS = {
    "taiwan_company": "#e74c3c",
    "international_company": "#3498db",
    "technology": "#2ecc71",
    "material": "#f39c12",
    "application": "#9b59b6",
}
CATEGORY_LABELS = {
    "taiwan_company": "台灣公司",
    "international_company": "國際公司",
    "technology": "技術/標準",
    "material": "材料/基板",
    "application": "終端應用",
}
ALIASES = {
    "TSMC": "台積電", "MediaTek": "聯發科", "Foxconn": "鴻海", "UMC": "聯電", "ASE": "日月光投控", "SPIL": "矽品",
    "Pegatron": "和碩", "Compal": "仁寶", "Quanta": "廣達", "Wistron": "緯創", "Inventec": "英業達", "ASUS": "華碩",
    "Acer": "宏碁", "Realtek": "瑞昱", "Novatek": "聯詠", "Himax": "奇景光電", "AUO": "友達", "Innolux": "群創",
    "Yageo": "國巨", "GlobalWafers": "環球晶", "KYEC": "京元電子", "ChipMOS": "南茂", "Unimicron": "欣興",
    "Delta": "台達電", "Lite-On": "光寶", "Largan": "大立光", "CTCI": "中鼎", "PTI": "力成", "WIN Semi": "穩懋",
    "Walsin": "華新科", "日月光": "日月光投控",
    "艾司摩爾": "ASML", "應用材料": "Applied Materials", "AMAT": "Applied Materials", "東京威力": "Tokyo Electron",
    "TEL": "Tokyo Electron", "科林研發": "Lam Research", "科磊": "KLA", "愛德萬": "Advantest", "英特爾": "Intel",
    "高通": "Qualcomm", "博通": "Broadcom", "輝達": "NVIDIA", "美光": "Micron", "海力士": "SK Hynix",
    "英飛凌": "Infineon", "恩智浦": "NXP", "瑞薩": "Renesas", "德州儀器": "Texas Instruments",
    "意法半導體": "STMicroelectronics", "安森美": "ON Semiconductor", "蘋果": "Apple", "三星": "Samsung",
    "索尼": "Sony", "谷歌": "Google", "微軟": "Microsoft", "特斯拉": "Tesla", "亞馬遜": "Amazon", "戴爾": "Dell",
    "惠普": "HP", "聯想": "Lenovo", "思科": "Cisco", "新思": "Synopsys", "益華": "Cadence", "安謀": "Arm",
    "ARM": "Arm", "博世": "Bosch", "電裝": "Denso", "信越": "Shin-Etsu", "信越化學": "Shin-Etsu", "Sumco": "SUMCO",
    "味之素": "Ajinomoto", "西門子": "Siemens", "霍尼韋爾": "Honeywell", "漢威": "Honeywell",
    "勞斯萊斯": "Rolls-Royce", "奇異": "GE Aerospace", "耐吉": "Nike", "耐克": "Nike", "愛迪達": "Adidas",
    "戴森": "Dyson",
    "SiC": "碳化矽", "GaN": "氮化鎵", "InP": "磷化銦", "GaAs": "砷化鎵", "共封裝光學": "CPO",
    "Co-Packaged Optics": "CPO", "IoT": "物聯網", "EV": "電動車", "印刷電路板": "PCB",
}

# --- themes ------------------------------------------------------------------------------------
#: Tag: name, description, related tags.
THEMES = {
    "CoWoS": ("CoWoS 先進封裝", "台積電 Chip-on-Wafer-on-Substrate 2.5D 先進封裝技術，AI 晶片關鍵製程", ["HBM", "2.5D 封裝", "3D 封裝", "ABF 載板", "矽中介層"]),
    "HBM": ("HBM 高頻寬記憶體", "High Bandwidth Memory，AI 加速器必備的高速堆疊記憶體", ["CoWoS", "AI 伺服器", "DRAM"]),
    "CPO": ("CPO 共封裝光學", "Co-Packaged Optics，將光學元件整合於晶片封裝中以突破頻寬瓶頸", ["矽光子", "光收發模組", "AI 伺服器", "資料中心"]),
    "矽光子": ("矽光子 Silicon Photonics", "以矽基製程整合光學元件，實現高速光互連，下一代資料中心核心技術", ["CPO", "EML", "VCSEL", "光收發模組", "資料中心"]),
    "VCSEL": ("VCSEL 垂直共振腔面射型雷射", "3D 感測、光通訊及 LiDAR 核心光源元件", ["矽光子", "光收發模組", "砷化鎵"]),
    "碳化矽": ("碳化矽 SiC", "第三代半導體材料，耐高壓高溫，電動車逆變器及充電樁關鍵材料", ["電動車", "MOSFET", "IGBT", "氮化鎵"]),
    "氮化鎵": ("氮化鎵 GaN", "第三代半導體材料，高頻高效，5G 基站、快充及衛星通訊核心", ["5G", "碳化矽", "磷化銦"]),
    "磷化銦": ("磷化銦 InP", "III-V 族化合物半導體，光通訊雷射及高速光電元件基板材料", ["矽光子", "EML", "光收發模組", "砷化鎵"]),
    "AI 伺服器": ("AI 伺服器供應鏈", "AI 訓練與推論伺服器完整供應鏈，從晶片到系統到散熱", ["CoWoS", "HBM", "NVIDIA", "CPO", "資料中心"]),
    "資料中心": ("資料中心供應鏈", "超大規模資料中心基礎設施，涵蓋伺服器、網通、電源、散熱", ["AI 伺服器", "CPO", "矽光子", "PCB"]),
    "電動車": ("電動車供應鏈", "電動車完整供應鏈，從電池材料到功率元件到車用電子", ["碳化矽", "IGBT", "MOSFET", "車用電子"]),
    "5G": ("5G 通訊供應鏈", "5G 基礎建設與終端應用，涵蓋基站、天線、射頻前端、濾波器", ["氮化鎵", "RF", "低軌衛星"]),
    "低軌衛星": ("低軌衛星 LEO Satellite", "低軌道衛星通訊供應鏈，天線、地面站、射頻模組", ["5G", "氮化鎵", "RF"]),
    "EUV": ("EUV 極紫外光微影", "先進製程關鍵微影技術，7nm 以下節點必備", ["光阻液", "ASML"]),
    "光阻液": ("光阻液 Photoresist", "半導體微影製程關鍵化學材料", ["EUV", "微影"]),
    "ABF 載板": ("ABF 載板", "Ajinomoto Build-up Film 載板，高階 IC 封裝基板", ["CoWoS", "AI 伺服器", "PCB"]),
    "矽晶圓": ("矽晶圓", "半導體製造最基礎的原材料", ["碳化矽", "磊晶"]),
    "Apple": ("Apple 蘋果供應鏈", "蘋果公司台灣供應鏈成員", ["台積電", "鴻海"]),
    "NVIDIA": ("NVIDIA 輝達供應鏈", "NVIDIA GPU 及 AI 平台台灣供應鏈", ["CoWoS", "HBM", "AI 伺服器", "台積電"]),
    "Tesla": ("Tesla 特斯拉供應鏈", "特斯拉電動車台灣供應鏈成員", ["電動車", "碳化矽"]),
}
THEME_INDEX = {
    "先進封裝": ["CoWoS", "HBM", "CPO"],
    "光電與化合物半導體": ["矽光子", "VCSEL", "碳化矽", "氮化鎵", "磷化銦"],
    "AI / 資料中心": ["AI 伺服器", "資料中心", "NVIDIA"],
    "電動車 / 車用": ["電動車", "Tesla"],
    "通訊": ["5G", "低軌衛星"],
    "製程與設備": ["EUV"],
    "材料": ["光阻液", "ABF 載板", "矽晶圓"],
    "品牌供應鏈": ["Apple", "NVIDIA", "Tesla"],
}
#: Headings of a theme's page, in order; the first lines of the themes' index.
#: Companies that the mention index lists; the other categories are listed whole.
INDEX_LIMITS = {"international_company": 200, "taiwan_company": 300}
ROLE_LABELS = {"upstream": "上游", "midstream": "中游", "downstream": "下游", "related": "相關公司"}
THEME_INDEX_HEAD = ["# Thematic Investment Screens", "", "> Auto-generated supply chain maps for thematic investing.", "", "---", ""]
#: Words that place a company in the chain, in the order in which they are tested; characters before a tag that are looked at.
ROLES = {"上游": "upstream", "下游": "downstream", "中游": "midstream"}
ROLE_REACH = 100

# --- discovery ---------------------------------------------------------------------------------
SECTOR_GROUPS = {
    "tech": [
        "Semiconductors", "Semiconductor Equipment & Materials", "Electronic Components", "Computer Hardware",
        "Communication Equipment", "Consumer Electronics", "Software (Application)", "Software (Infrastructure)",
        "Electronics & Computer Distribution", "Information Technology Services", "Scientific & Technical Instruments",
    ],
    "industrial": [
        "Specialty Industrial Machinery", "Industrial Distribution", "Metal Fabrication", "Electrical Equipment & Parts",
        "Pollution & Treatment Controls", "Conglomerates", "Engineering & Construction",
        "Building Products & Equipment", "Tools & Accessories", "Auto Parts", "Aerospace & Defense",
    ],
    "materials": ["Chemicals", "Specialty Chemicals", "Steel", "Aluminum", "Copper", "Other Industrial Metals & Mining"],
    "energy": ["Solar", "Utilities - Renewable", "Utilities - Regulated Electric", "Oil & Gas Equipment & Services"],
    "consumer": [
        "Footwear & Accessories", "Textile Manufacturing", "Household & Personal Products", "Packaging & Containers",
        "Furnishings, Fixtures & Appliances", "Leisure", "Restaurants", "Grocery Stores", "Specialty Retail",
    ],
    "finance": [
        "Banks - Diversified", "Banks - Regional", "Insurance - Life", "Insurance - Property & Casualty",
        "Capital Markets", "Financial - Credit Services", "Financial Conglomerates",
    ],
    "real_estate": ["Real Estate - Development", "Real Estate - Diversified", "REIT - Diversified"],
}
PROFILES = {
    "tech": ["tech", "industrial", "materials"],
    "energy": ["tech", "industrial", "energy", "materials"],
    "consumer": ["consumer", "tech"],
    "all": None,
}
TECH_KEYWORDS = [
    "半導體", "晶片", "IC", "AI", "伺服器", "封裝", "製程", "光電", "通訊", "5G", "衛星", "記憶體", "電池", "充電", "散熱",
    "矽", "雷射", "光纖", "感測", "量子", "ASIC", "GPU", "HBM", "PCB", "LED", "OLED", "EUV", "SiC", "GaN", "MEMS", "RF",
    "CPO",
]
ENERGY_KEYWORDS = ["能源", "電力", "風電", "太陽能", "儲能", "氫能", "核", "碳", "綠電", "充電", "電網"]
SNIPPET_REACH, SNIPPETS = 30, 3

# --- statements --------------------------------------------------------------------------------
#: Metric: line items in order of preference.
METRIC_ITEMS = {
    "revenue": ["Total Revenue"],
    "gross_profit": ["Gross Profit"],
    "selling_exp": ["Selling And Marketing Expense"],
    "rd_exp": ["Research And Development"],
    "admin_exp": ["General And Administrative Expense"],
    "operating_income": ["Operating Income"],
    "net_income": ["Net Income", "Net Income Common Stockholders"],
    "ocf": ["Operating Cash Flow", "Total Cash From Operating Activities"],
    "icf": ["Investing Cash Flow", "Total Cashflows From Investing Activities"],
    "fcf": ["Financing Cash Flow", "Total Cash From Financing Activities"],
    "capex": ["Capital Expenditure", "Capital Expenditures"],
    "sga": ["Selling General And Administration"],
    "free_cash_flow": ["Free Cash Flow"],
}
#: Output label of each metric, in order; margins are not scaled.
METRIC_LABELS = {
    "revenue": "Revenue", "gross_profit": "Gross Profit", "gross_margin": "Gross Margin (%)",
    "selling_exp": "Selling & Marketing Exp", "rd_exp": "R&D Exp", "admin_exp": "General & Admin Exp",
    "operating_income": "Operating Income", "operating_margin": "Operating Margin (%)", "net_income": "Net Income",
    "net_margin": "Net Margin (%)", "ocf": "Op Cash Flow", "icf": "Investing Cash Flow", "fcf": "Financing Cash Flow",
    "capex": "CAPEX",
}
PERIODS = {"A": 3, "Q": 4}
MULTIPLES = {
    "trailingPE": "P/E (TTM)",
    "forwardPE": "Forward P/E",
    "priceToSalesTrailing12Months": "P/S (TTM)",
    "priceToBook": "P/B",
    "enterpriseToEbitda": "EV/EBITDA",
}
