"""Word lists, marks and weights that results depend on. Longer lists come in as parameters."""

from __future__ import annotations

# Stop words, lexicon and abbreviations.
EN_STOP = (
    "the a an of to in on at for and or but is are was were be been being this that "
    "these those it its as with by from he she they we i you my your his her their our "
    "not no do does did have has had will would can could should may might must"
).split()
ZH_STOP = (
    "的 了 和 是 在 我 有 与 及 或 但 而 也 这 那 你 他 她 它 我们 你们 他们 "
    "个 之 着 过 都 就 还 又 把 被 让 使 对 从 给 向 为 以 于 不 没 没有"
).split()
EN_POSITIVE = "good great nice excellent wonderful happy love like best amazing perfect positive".split()
EN_NEGATIVE = "bad terrible awful horrible sad hate dislike worst poor negative ugly wrong".split()
ZH_POSITIVE = "好 喜欢 优秀 开心 快乐 满意 爱 赞 美好 棒 不错 成功".split()
ZH_NEGATIVE = "坏 差 讨厌 糟糕 难过 失败 痛苦 愤怒 失望 错 烂 不行".split()
TITLES = "mr mrs ms dr prof sr jr st".split()
ABBREVIATIONS = "inc ltd corp co llc plc gmbh sa ag vs etc approx no ave blvd dept fig vol pp et al eq ch jan feb mar apr jun jul aug sep sept oct nov dec".split()
EN_MARKS = ",.!?;:\"'()-—…"
ZH_MARKS = "，。！？、；：（）《》【】…—～·「」『』﹁﹂〔〕〈〉〖〗'"
#: Weights of the eight fingerprint dimensions, in the order in which they are summed.
WEIGHTS = {"word_length": 0.10, "function_words": 0.30, "char_ngrams": 0.05, "word_bigrams": 0.15, "sentence_stats": 0.10, "punctuation": 0.15, "ttr": 0.10, "hapax": 0.05}

# Function words, in the order in which their lists are given; the results of the fingerprint depend on every one of them.
EN_FUNCTION = (
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our "
    "ours ourselves they them their theirs themselves who whom whose which what whatever the a an this that these those "
    "each every all both some any no none few many much several most more less such other another in on at to for from of "
    "with by about into onto upon through throughout during before after above below between among under over against "
    "within without near behind across along around beyond up down off out toward towards until till since despite beside "
    "besides except including and but or nor so yet although though because while if when where unless whereas whether than "
    "as once either neither be am is are was were being been have has had having do does did doing will would shall should "
    "can could may might must ought not never ever always often sometimes usually rarely seldom just already still almost "
    "also too very really quite rather only even perhaps maybe probably certainly indeed however therefore thus moreover "
    "furthermore nevertheless then now here there one two three four five six seven eight nine ten first second third last "
).split()
ZH_FUNCTION = (
    "我 你 他 她 它 我们 你们 他们 她们 它们 自己 别人 大家 本人 彼此 各自 自身 他人 这 那 这些 那些 这里 那里 这边 那边 这么 那么 这样 那样 这个 那个 这次 那次 什么 谁 哪 怎么 怎么样 多少 几 哪边 在 "
    "从 到 向 对 给 为 跟 和 与 同 比 被 把 将 由 按 按照 以 除了 关于 对于 根据 经过 通过 沿着 顺着 朝 往 当 趁 自从 为了 因为 由于 及 以及 或 或者 但 但是 而 而且 并且 然而 虽然 所以 因此 如果 "
    "假如 即使 尽管 不管 无论 除非 只要 只有 不但 不仅 还 也 又 就 才 便 则 于是 然后 接着 之后 要不 要不然 何况 况且 至于 的 地 得 了 着 过 吗 呢 吧 啊 呀 嘛 呗 喽 嗯 哦 之 所 等 而言 来说 很 "
    "都 刚 已经 曾经 正在 将要 常常 总是 一直 始终 一向 从来 永远 终于 忽然 突然 立刻 马上 渐渐 逐渐 重新 再 另外 大约 大概 几乎 简直 尤其 特别 不 没 没有 未 别 不要 不必 个 种 次 回 遍 趟 张 条 件 "
    "本 支 只 块 片 些 点 段 一 二 三 四 五 六 七 八 九 十 百 千 万 第一 第二 第三 每 各 某 任何 所有 今天 明天 昨天 现在 以前 以后 上 下 前 后 中 内 外 里 年 月 日 时 分 秒 "
).split()
