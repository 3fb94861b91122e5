"""Messages of a conversation: what a whole message is, whether a question stands alone, and its search terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.text import nfkc

# Whole messages by intent (after folding, without blanks and marks), words that refer back, words of
# comparison or of several questions, and the longest question that is looked up as it is.
INTENTS = [
    ("greeting", "(hello|hi|hey|goodmorning|goodafternoon|goodevening|你好[呀啊哇]?|您好|嗨|早上好)+"),
    ("thanks", "(ok)?(thanks|thankyou|thankyouverymuch|谢谢|感谢)(你|您)?"),
    ("acknowledgement", "ok|okay|isee|gotit|好|好的|明白了|知道了|收到"),
    ("goodbye", "bye|goodbye|seeyou|再见|拜拜"),
    ("capabilities", "whoareyou|whatcanyoudo|你是谁|你能做什么"),
]
REFERS = r"它|他们|这个|那个|上述|前面|刚才|\b(it|they|them|this one|that one|the above)\b"
COMPARES = r"对比|比较|区别|还是|为什么|怎么办|\b(versus|vs|compare[ds]?|difference|better|worse|why|which is)\b"
SIMPLE = 40


def intent(c: Column) -> Column:
    """The intent of a message that says nothing else; null for a question, even one that begins with a greeting."""
    bare = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"[\s，。！？、,.!?:：；;～~…'’]+", "")
    found = F.lit(None).cast("string")
    for name, pattern in reversed(INTENTS):
        found = F.when(bare.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


def stands_alone(c: Column) -> Column:
    """Whether a question can be searched as it is: short, without words that refer back or compare."""
    q, low = F.trim(F.coalesce(c, F.lit(""))), F.lower(F.coalesce(c, F.lit("")))
    return (q != "") & (F.length(q) <= SIMPLE) & ~low.rlike(REFERS) & ~low.rlike(COMPARES)
