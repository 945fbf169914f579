"""SQL of the screening rules, written out. It shares no constant with `functions.screening`, so a value that is wrong there shows."""

from __future__ import annotations


def _most(text: str, *forms: tuple[str, int]) -> str:
    every = ", ".join(f"regexp_extract_all({text}, '{form}', {group})" for form, group in forms)
    return f"list_max(list_transform(list_concat({every}), lambda x: TRY_CAST(x AS INTEGER)))"


def years_sql(flavour: str, text: str) -> str:
    """P26 over lower-case text."""
    if flavour == "scan":
        return _most(
            text,
            (r"(?:minimum|min\.?|at least)\s*(\d+)\+?\s*(?:years?|yrs?)", 1),
            (r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:relevant|related|professional|industry|work)?\s*experience", 1),
        )
    if flavour == "server":
        return _most(
            text,
            (r"(?:minimum|min\.?|at least|至少)\s*(\d+)\+?\s*(?:years?|年)", 1),
            (r"(\d+)\+?\s*(?:years?|年)\s+(?:of\s+)?(?:relevant|related|professional|industry|work)?\s*experience", 1),
            (r"(\d+)\s*年(?:及|或)?以上(?:相关)?(?:工作)?经验", 1),
        )
    if flavour == "china":
        return _most(
            text,
            (r"(?:至少|最低|要求)\s*(\d+)\s*年", 1),
            (r"(\d+)\s*年(?:以上)?(?:相关|工作|行业)?经验", 1),
            (r"经验\s*(\d+)\s*[-–—至]\s*(\d+)\s*年", 1),
            (r"经验\s*(\d+)\s*[-–—至]\s*(\d+)\s*年", 2),
        )
    both = (
        (r"(?:至少|最低|要求|需具备)\s*(\d+)\s*年", 1),
        (r"(\d+)\s*年(?:以上)?(?:相关|工作|行业|专业)?经验", 1),
        (r"(?:minimum|at least)\s+(\d+)\+?\s+years?", 1),
        (r"(\d+)\+?\s+years?(?:\s+of)?\s+(?:relevant|related|professional|industry|work)?\s*experience", 1),
    )
    if flavour == "portal":
        return _most(text, *both)
    return _most(text, *both, (r"经验\s*(\d+)\s*[-–—至]\s*(\d+)\s*年", 1), (r"经验\s*(\d+)\s*[-–—至]\s*(\d+)\s*年", 2))


def visa_sql(flavour: str, text: str) -> str:
    """P25 over lower-case text."""
    if flavour == "scan":
        return f"""CASE WHEN regexp_matches({text}, '(?:will not|does not|unable to|not provide).{{0,50}}(?:sponsor|sponsorship)') THEN '明确不支持'
            WHEN regexp_matches({text}, '(?:visa|h-?1b).{{0,50}}(?:sponsor|sponsorship)|sponsorship available') THEN '可能支持' ELSE 'JD 未明确' END"""
    return f"""CASE WHEN regexp_matches({text}, '(will not|does not|unable to|not provide).{{0,40}}(sponsor|sponsorship)') THEN '明确不支持'
        WHEN regexp_matches({text}, '(visa|h-?1b).{{0,40}}(sponsor|sponsorship)|sponsorship available') THEN '可能支持' ELSE 'JD 未明确' END"""


_WANTED = {
    "scan": "biostatistician|statistical scientist|data scientist|applied scientist|research scientist|decision scientist|quantitative researcher|quantitative analyst|epidemiologist|health economics|outcomes research|algorithm validation|imaging scientist",
    "server": "data scientist|applied scientist|research scientist|decision scientist|machine learning scientist|quantitative researcher|quantitative analyst|statistical scientist|biostatistician|epidemiologist|health economics|outcomes research|algorithm validation|imaging scientist|clinical data scientist|rwe scientist|real world evidence|healthcare consultant|life sciences consultant|数据科学家|数据科学|应用科学家|研究科学家|算法科学家|决策科学家|算法研究员|创新算法|科学计算|计算科学家|计算生物|ai for science|生物统计|统计科学家|临床统计|医学统计|统计师|流行病学|真实世界研究|真实世界证据|卫生经济|健康经济|结局研究|量化研究|定量研究|量化分析|医学影像|影像科学家|医疗咨询|医药咨询|生命科学咨询",
    "china": "生物统计|统计|统计科学|数据科学|数据科学家|数据分析师|数据分析|人工智能|机器学习|深度学习|计算机视觉|医学影像|生物信息|生信分析|机器学习科学家|算法研究员|算法科学家|创新算法|科学计算|计算科学家|计算生物|ai for science|量化研究|量化分析|流行病|卫生经济|真实世界|医学统计|临床统计|医疗咨询|healthcare consulting|biostatistician|statistical scientist|data scientist|quantitative researcher|epidemiologist|machine learning|artificial intelligence|computer vision|bioinformatics",
}


def wanted_sql(flavour: str, title: str = "title") -> str:
    """F1."""
    return f"regexp_matches(lower({title}), '{_WANTED[flavour]}')"


def excluded_sql(title: str = "title") -> str:
    """the same for the scan and the server."""
    return f"""regexp_matches(lower({title}), 'intern|postdoc|postdoctoral|software engineer|data engineer|machine learning engineer|nlp|language model|generative ai|llm|director|vice president|senior|principal|staff|manager|lead|head of|technical leadership|\\bsr\\.?(?:\\s|$)|\\bexperienced hire\\b|\\bresearch scientist\\s+(?:iii|iv|v|[3-9])\\b')"""


_if = lambda t, p, n: f"CASE WHEN regexp_matches({t}, '{p}') THEN {n} ELSE 0 END"
_YEARS_POINTS = "CASE WHEN years IS NULL THEN 4 WHEN years = 0 THEN 10 WHEN years <= 3 THEN 8 ELSE 0 END"
_EN_GAPS = ("large language model", " retrieval augmented generation", " natural language processing", "foundation model", "reinforcement learning", "deep learning architecture", "image segmentation", "production ml", "mlops", "distributed training", "model serving", "full-stack", "full stack")
_SERVER_GAPS = (
    r"large language model|\bllm\b|\brag\b|natural language processing|\bnlp\b", "fine.tun(?:e|ing)|reinforcement learning|foundation model", "deep learning architecture|computer vision|image segmentation",
    "production ml|mlops|distributed training|model serving", "full.stack|backend engineer|frontend engineer|software engineering",
)


def gaps_sql(flavour: str, t: str = "t") -> str:
    return "(" + " + ".join(_if(t, g, 1) for g in (_SERVER_GAPS if flavour == "server" else _EN_GAPS)) + ")"


def score_sql(flavour: str, visa: str | None = None, t: str = "t") -> str:
    """C1 (server), C2 (scan), C3 (china) over lower-case title and text `t`, `years` and a column of P25's labels (null outside the US)."""
    tools = _if(t, r"(?:^|\W)r(?:\W|$)|\brstudio\b", 7), _if(t, r"\bpython\b", 5)
    if flavour == "china":
        parts = [
            "15", f"CASE WHEN regexp_matches({t}, '博士|ph\\.?d\\.?|doctorate|doctoral') THEN 10 WHEN regexp_matches({t}, '统计|生物统计|流行病|数学|经济|数据科学|quantitative') THEN 6 ELSE 0 END",
            f"CASE WHEN {wanted_sql('china')} THEN 12 ELSE 0 END",
            "least(30, " + " + ".join([_if(t, "生物统计|医学统计|统计建模|统计分析|biostat|statistical", 10), _if(t, "研究设计|试验设计|临床试验|study design|clinical trial", 7), _if(t, "预测模型|风险预测|机器学习|machine learning", 6), _if(t, "因果推断|纵向数据|缺失数据|生存分析|causal|longitudinal", 7)]) + ")",
            "least(20, " + " + ".join([_if(t, "临床|医疗|医药|患者|制药|生物科技|clinical|medical|pharma", 8), _if(t, "医学影像|神经影像|多模态|数字生物标志物", 6), _if(t, "真实世界|卫生经济|药物流行病|rwe|heor", 6), _if(t, "实验|决策科学|产品分析|量化研究|咨询", 5)]) + ")",
            "least(15, " + " + ".join([*tools, _if(t, "数据分析|统计编程|sas|sql", 3)]) + ")",
        ]
    else:
        server = flavour == "server"
        more = lambda en, zh: f"{en}|{zh}" if server else en
        parts = [
            f"CASE WHEN regexp_matches({t}, '{more(r'\bph\.?d\.?\b|doctoral|doctorate', '博士|硕博|硕士(?:研究生)?(?:及|或)?以上')}') THEN 10"
            f" WHEN regexp_matches({t}, '{more('statistics|biostatistics|epidemiology|data science|mathematics|economics|quantitative', '统计|生物统计')}') THEN 6 ELSE 0 END",
            "least(30, " + " + ".join([_if(t, more("biostatistics|statistical modeling|statistical analysis|statistics", "生物统计|统计建模"), 10), _if(t, more("study design|research design|experimental design|clinical trial", "研究设计|临床试验"), 7), _if(t, more("predictive model|risk prediction|risk stratification|machine learning", "预测模型|风险分层"), 6), _if(t, more("causal inference|longitudinal|repeated measures|missing data|survival analysis", "因果推断|纵向数据|缺失数据"), 7)]) + ")",
            "least(20, " + " + ".join([_if(t, more("clinical|healthcare|medical|patient|ehr|pharma|biotech", "临床|医疗|医药"), 8), _if(t, more("neuroimaging|medical imaging|multimodal|digital biomarker|wearable", "医学影像|神经影像"), 6), _if(t, r"real.world evidence|\brwe\b|\bheor\b|epidemiology|pharmacoepidemiology|regulatory science", 6), _if(t, "experimentation|decision science|product analytics|quantitative research|systematic research", 5)]) + ")",
            "least(15, " + " + ".join([*tools, _if(t, more("data analysis|statistical programming", "数据分析"), 3)]) + ")",
            f"CASE WHEN {visa} IS NULL THEN 15 WHEN {visa} = '可能支持' THEN 15 WHEN {visa} = 'JD 未明确' THEN 7 ELSE 0 END",
        ]
    return f"CAST(greatest(0, least(100, {' + '.join([_YEARS_POINTS, *parts])} - least(40, 15 * {gaps_sql(flavour, t)}))) AS INTEGER)"


def eligible_sql(flavour: str, visa: str, t: str = "t", content: str = "content") -> str:
    """A column of P25's labels, null outside the US."""
    citizen = r"u\.?s\.? citizen|us citizenship|required clearance|security clearance" + ("|公民身份" if flavour == "server" else "")
    return (
        f"(NOT regexp_matches({t}, '{citizen}') AND coalesce({visa} <> '明确不支持', true)"
        f" AND NOT (coalesce(years > 3, false) AND NOT regexp_matches(lower({content}), '(?:ph\\.?d\\.?|doctorate).{{0,80}}(?:count|equivalent|substitut)')) AND {gaps_sql(flavour, t)} < 2)"
    )


def server_track_sql(t: str = "t") -> str:
    """P23 as the server has it."""
    rules = (
        ("Quant", "quantitative researcher|quantitative analyst|systematic|量化研究|定量研究|量化分析"),
        ("Pharma", "biostat|statistical scientist|clinical trial|epidemiol|health economics|outcomes research|生物统计|临床统计|医学统计|流行病|卫生经济|健康经济|真实世界"),
        ("Healthcare Consulting", "healthcare consultant|life sciences consultant|医疗咨询|医药咨询|生命科学咨询"),
        ("Healthcare AI", "health|clinical ai|medical|imaging"),
        ("Medical Device", "device|diagnostic|algorithm validation"),
    )
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{k}'" for k, p in rules) + " ELSE 'Technology' END"


def server_skills_sql(content: str = "content") -> str:
    """P27 as the server has it: the first seven."""
    rules = (
        ("Python", r"(?i)\bpython\b"), ("R", r"(?:^|\W)R(?:\W|$)"), ("SQL", r"(?i)\bsql\b"), ("SAS", r"(?i)\bsas\b"), ("Statistics", r"(?i)\bstatistic"), ("Biostatistics", r"(?i)\bbiostat"),
        ("Causal inference", "(?i)causal inference|propensity score|inverse probability|target trial"), ("Experimentation", "(?i)experiment(?:al)? design|a/b test|randomized experiment"),
        ("Machine learning", "(?i)machine learning|statistical learning|predictive model"), ("Clinical trials", "(?i)clinical trial|randomized controlled trial|estimand"),
        ("Longitudinal data", "(?i)longitudinal|repeated measures|mixed.effects|survival analysis"), ("Model validation", "(?i)external validation|calibration|generaliz|fairness|bias analysis|model evaluation"),
        ("Medical imaging", "(?i)medical imaging|neuroimaging|multimodal imaging|digital biomarker"), ("RWE / HEOR", r"(?i)real.world evidence|\brwe\b|\bheor\b|health economics|pharmacoepidemi"),
    )
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({content}, '{p}') THEN '{k}' END" for k, p in rules) + "], lambda x: x IS NOT NULL)[1:7]"
