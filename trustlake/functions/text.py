"""Identifiers and search text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in column names that hint at personal data or secrets, in Latin and in Han script.
SENSITIVE_LATIN = ["phone", "mobile", "email", "id_card", "idcard", "passwd", "password", "secret", "token", "ssn", "bank", "card_no"]
SENSITIVE_HAN = ["姓名", "身份证", "手机", "电话", "邮箱", "地址", "银行", "密码"]
LONGEST_TERM = 8
# Words of Han text that searches know.
LEXICON = """
客户 订单 明细 数据 资产 血缘 质量 契约 策略 权限 审批 采集 调度 元数据 模型 指标 口径 报表 仪表板 图表 数据集 数据库
数据源 字段 视图 分区 索引 存储 查询 分析 监控 告警 异常 检测 规则 剖析 分级 分类 敏感 脱敏 加密 审计 日志 事件 任务
作业 流程 授权 角色 用户 团队 组织 项目 空间 命名空间 租户 版本 历史 回滚 差异 兼容 覆盖率 健康度 队列 复核 驳回 确认
采纳 建议 术语 同义词 语义 检索 搜索 召回 排序 融合 向量 嵌入 提示词 代理 工具 调用 限流 缓存 重试 幂等 事务 并发 交易
支付 退款 库存 商品 门店 渠道 销售 收入 成本 利润 预算 财务报表 账号 账户 余额 流水 风控 授信 逾期 催收 客户画像
用户行为 访问 登录 注册 操作 变更 发布 上线 回滚 容量 性能 延迟 吞吐 可用性 稳定性 故障 事故 根因 预案 值班 通知 邮件
短信 工单 需求 缺陷 测试 验收 部署 配置 密钥 证书 网络 网关 接口 服务 微服务 容器 集群 节点 副本 备份 恢复 迁移 归档
生命周期 主数据 参考数据 数据目录 数据地图 数据产品 数据服务 数据治理 数据安全 数据合规 个人信息 数据出境 数据分级
""".split()


def tokens(text: Column) -> Column:
    """Words of an identifier or a text: camel case split, anything but letters and digits a gap, lower case."""
    split = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\p{Ll}\p{N}])(?=\p{Lu})", "$1 ")
    gaps = F.lower(F.trim(F.regexp_replace(split, r"[^\p{L}\p{N}]+", " ")))
    return F.filter(F.split(gaps, " "), lambda t: t != "")


def han_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{IsHan}+)"), F.lit(1))


def grams(runs: Column, n: int) -> Column:
    """All parts of n characters of each string of an array."""
    own = lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, own))


def han_terms(text: Column) -> Column:
    """Two-character parts of each run of Han characters, and a run of one as it is."""
    runs = han_runs(text)
    own = F.array_distinct(F.concat(grams(runs, 2), F.filter(runs, lambda r: F.length(r) == 1)))
    # No Han character stands before U+2E80, which is told faster than its script.
    return F.when(text.rlike(r"[\x{2E80}-\x{10FFFF}]"), own).otherwise(F.array().cast("array<string>"))


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of some words that stands at a place, as a trie: no place is tried word by word."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        each = [re.escape(c) + of(rest) for c, rest in sorted(node.items()) if c]
        # A word that ends here is taken only if none of the longer ones goes on.
        return f"(?:{'|'.join(each)}){'?' if '' in node else ''}" if each else ""

    return of(root)


def segments(run: Column, words: list[str] = LEXICON) -> Column:
    """A run of Han characters cut into words of a lexicon and single characters, by maximum match from both ends.

    Of the two the one with fewer words and single characters is taken (a single one counts three times), of equal ones
    that from the start. The lexicon becomes a part of the plan; words have 2 to LONGEST_TERM characters.
    """
    known = [w for w in dict.fromkeys(words) if 2 <= len(w) <= LONGEST_TERM]
    cut = lambda text, own: F.regexp_extract_all(text, F.lit(f"(?s)({trie_pattern(own)}|.)" if own else "(?s)(.)"), F.lit(1))
    forward = cut(run, known)
    backward = F.reverse(F.transform(cut(F.reverse(run), [w[::-1] for w in known]), F.reverse))
    score = lambda tokens: F.size(tokens) + 2 * F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return F.when(score(forward) <= score(backward), forward).otherwise(backward)


def han_index_terms(text: Column, words: list[str] = LEXICON) -> Column:
    """What a text's Han runs are found by: their words, then all parts of two characters; a run of one as it is."""
    own = lambda run: F.concat(F.filter(segments(run, words), lambda t: (F.length(t) > 1) | (F.length(run) == 1)), grams(F.array(run), 2))
    return F.array_distinct(F.flatten(F.transform(han_runs(text), own)))


def han_candidates(text: Column) -> Column:
    """All parts of 2 to 8 Han characters, to be joined with a lexicon."""
    runs = han_runs(text)
    return F.array_distinct(F.concat(*[grams(runs, n) for n in range(2, LONGEST_TERM + 1)]))


def search_text(*parts: Column) -> Column:
    """The text that a document is found by: name, URN, path, description, tags, synonyms."""
    return F.trim(F.concat_ws(" ", *parts))


def is_sensitive_name(name: Column) -> Column:
    return name.rlike("(?i)(" + "|".join(SENSITIVE_LATIN + SENSITIVE_HAN) + ")")
