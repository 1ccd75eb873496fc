"""Problem 8: personal details in free text, found and replaced by typed placeholders.

Method: a linear-chain conditional random field over word shapes, the words that the labelled table knows, and their
neighbours, decoded by Viterbi for whole batches of lines. The labelled table is small and written here: sentences in
five languages with gaps, filled by rule, among sentences without personal details. An exact check of each span's form
follows and settles its edges. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import crf
from millrace.llm import wordgrid as W

KINDS = ["email", "phone", "id_number", "address", "name"]
#: Sentences in the labelled table.
TABLE_SENTENCES = 6000
LABELS = 1 + 2 * len(KINDS)

# ---------------------------------------------------------------------------------------------- the labelled table
#: Sentences with gaps. {E} email, {P} phone, {I} identity number, {A} address, {N} name, {n} number, {w} word, {W} capitalised word.
MARKED = [
    "Please mail {E} for the files.", "Contact: {E}", "Send it to {E} today.", "Contact us at {E}.", "<{E}>", "mailto:{E}", "(see {E})", "| email | {E} | {n} |", '{"mail": "{E}", "n": {n}}', "Bugs go to ({E}) at once.", "It came from {E} on {W}.", "E-Mail: {E}", "Schreiben Sie an {E} bitte.", "Bitte {E} fragen.", "Écrivez à {E} pour plus.", "Courriel : {E}", "Escriba a {E} si es posible.", "Correo: {E}", "邮箱:{E}", "邮件发到 {E} 即可。", "联系{E}。", '"email": "{E}",', "{E}", "Email {E} si falla.",
    "Call {P} tomorrow.", "Phone {P}, weekends only.", "My number is {P}.", "tel:{P}", "Tel. {P}", "Reach us on {P} or write.", "| phone | {P} | {n} |", '{"phone": "{P}", "n": {n}}', "Telefon {P}", "Rückfragen unter {P} bitte.", "Téléphone : {P}", "Appelez {P} demain.", "Llame al {P} mañana.", "Teléfono {P}", "电话:{P}", "请拨 {P} 联系。", "致电{P}。", "{P}", "The hotline is {P}.", '{"tel": "{P}"}', "{P} ({w})", '{"phone": "{P}", "rank": {d}}', '{"tel": "{P}", "rank": {d}}',
    "SSN: {I}.", "SSN on record: {I}.", "SSN on the sheet: {I}.", "ssn {I}", "The page lists identity number {I}.", "His identity number is {I}.", "Social security number {I}.", "ID no. {I} was kept.", "No. {I} is on the passport.", "DNI {I} {Q}", "SSN: {I}. {S} the {w} is {w}.", "identity number {I}. {S} the {w} {w}.", "Her ID number is {I}.", "ID no. {I} was found in it.", "passport {I}, as copied", "The form lists identity number {I}.", "| identity no. | {I} | {n} |", "| id | {I} | {n} |", '{"ssn": "{I}", "n": {n}}', '{"national_id": "{I}", "n": {n}}', "{I} was in the log.", "Ausweisnummer {I}", "Die Kennung {I} steht im Text.", "Personalausweis {I}", "Pièce d'identité n° {I}", "Le numéro {I} figure au dossier.", "DNI {I}", "Documento de identidad {I}.", "El documento {I} aparece.", "身份证号 {I}", "证件号码:{I}。", "护照 {I}", "身份证{I}。", "passport or card {I}, copied", "identity card {I}",
    "Ship it to {A}, third floor.", "Return address: {A}", "We meet at {A} on {W}.", "Flat {n}, {A}", "| street | {A} | {n} |", '{"street": "{A}", "n": {n}}', '{"ship_to": "{A}", "n": {n}}', "The office is at {A}.", "Apartment {n}, {A}", "Anschrift: {A}", "Lieferung nach {A}, Hinterhaus.", "Adresse: {A}", "Wohnhaft {A}, {W}", "Adresse : {A}", "Livraison au {A}, troisième étage.", "Dirección: {A}", "Entrega en {A}, tercer piso.", "地址:{A}", "请寄到{A}。", "住址 {A}", "{A}", "寄往{A}三楼。", "Visit {A} for that.",
    "Author: {N}", "Reviewed by {N}.", "Thanks to {N} for this.", "Thanks to Dr. {N} for the pass.", "Prof. {N} agrees.", "Mr. {N} and Ms. {N} agree.", "As {N} pointed out, it is flat.", "I spoke with {N} about it.", "-- {N}", "-- {N}", "-- {N} {S} the {w} {w}.", "Author: {N} {S} {w} the {w}.", "作者:{N}{Z}可以看到，{k}{v}了{k}。", "作者:{N}{k}与{k}{z}进行了比较。", "姓名:{N}{Z}，{k}{z}{v}了{k}。", "| name | {N} | {n} |", '{"author": "{N}", "n": {n}}', '{"full_name": "{N}", "n": {n}}', "{N} wrote this.", "Signed, {N}", "Autor: {N}", "Geprüft von {N}.", "Laut {N} stimmt es.", "Herr {N} sagt nein.", "Auteur : {N}", "Relu par {N}.", "Selon {N}, la valeur est bonne.", "Selon Mme {N}, oui.", "Merci à {N} pour cela.", "Revisado por {N}.", "Según {N}, el valor es bueno.", "Gracias a {N} por esto.", "作者:{N}", "据{N}说,结果对。", "本节由{N}审阅。", "感谢{N}的帮助。", "姓名:{N}", "由{N}审核", "by {N} {E}", "{N} ({P})", "Ask Ms. {N} first.", "Dank an Dr. {N} für dies.",
]
#: Sentences without personal details; {F} a family name alone, {H} a hexadecimal run, {n} a number.
PLAIN = [
    "The {w} {w} the {w} after the {w}.", "If the {w} is {w}, then the {w} {w} nothing.", "Between step {n} and step {n} the {w} {w} its {w}.", "Our {w} {w} {n} of {n} {w} entries.", "See the {F} Lemma for the bound.", "The {F} Theorem holds here.", "By the {F} inequality it follows.", "The {F} distribution is wide.", "{W} {W} and {W} {W} are project names.", "The project {W} {W} is old.", "We use {W} {W} and {W} {W} as names of projects.", "Bind the server to {n}.{n}.{n}.{n} for now.", "Host {n}.{n}.{n}.{n} is down.", "Release {n}.{n}.{n} fixes it.", "Version {n}.{n} is out.", "On 20{d}{d}-{d}{d}-{d}{d} the job {L} restarted.", "Job {L} ended on {n}.", "The invoice INV-{n}-{L} is settled.", "Order no. {L} was shipped.", "Run {H} finished.", "Commit {H} broke it.", "Shapes went from {n}-{n}-{n} to {n}-{n}-{n}.", "Accuracy rose from 0.{n} to 0.{n} over {d} seeds.", "step:{n} - critic/score/mean:0.{n} - actor/kl:0.0{n} - perf/tokens:{L}", "Use @{w}_{w} and {w}@{d}.{d} in the setup.", "{w} = [{n}, {n}, {n}]", "for {w} in range({n}):", "def {w}_{w}({w}, limit={n}):", "We compute {n} * {n}, which is {n}.", "The answer is \\boxed{{n}}.", "# {w}", "# {W} {w}", '{"complexity_score": {d}.{d}, "is_suitable": true, "rejection_reason": null}', "Find the product of {n} and {d}, then write it.", "How many {w} are there in {n} {w}?", "↑ {n}", "| {w} | {w} | {n} |", "Line {n} of {w}.{w}: {w} expected {n}", "{n} {w} and {n} {w} of {w}", "At {n}:{n} the {w} stopped.", "RFC {n} and ISO {n} differ.", "Table {n} shows {w} {w}.",
    "{S} the {w} {w} the {w}.", "{S} {w} {w} a {w} of {n}.", "{S} the {w} is {w}, the {w} {w} more of the {w}.", "{S} {w}, the {w} {w} {n} of {n}.", "{S} nobody expected that every {w} {w} one {w}.", "Shapes went from {d}{d}{d}-{d}{d}-{d}{d}{d}{d} to {d}{d}{d}-{d}{d}-{d}{d}{d}{d}.", "The tensor has shape {d}{d}{d}-{d}{d}-{d}{d}{d}{d} now.", "Sizes are {d}{d}{d}-{d}{d}-{d}{d}{d}{d} and {n}-{n}.", "Between {n}-{n}-{n} and {d}{d}{d} {d}{d} {d}{d}{d}{d} rows.", "Beside a {w} {w}, the {w} fills {n} {w} jars with {n} {w} apiece at noon.", "Take {n} {w} from a {w}, then subtract {n} from the {w} share.", "He counts {n} {w} of {w} at dusk.", "Dividing {n} {w} by the {w} ratio leaves {n} {w}.", "Each {w} costs {n} units and the team orders {n} of them.",
    "{D} {G} ersetzt den {G} im zweiten Versuch.", "{D} {w} der {G} bei gerader Anzahl.", "{D} {G} und die {G} sind gleich, {w} das {G} nicht.",
    "{Q} la {w} reste la même, on voit que le {w} change.", "{Q} le {w} vérifie une partie du lot.", "{Q} vemos que la {w} comprueba el valor medio.", "{Q} el {w} no cambia.",
    "{Z}，{k}{v}了{k}。", "{Z}可以看到，{k}{v}了{n}个{k}。", "{Z},{k}{z}{v}了{k}。", "{k}与{k}{z}进行了比较。", "{z}，{k}{v}了{k}，而{k}保持不变。", "如果没有{k}，{k}就{v}了{k}。", "从第{n}步到第{n}步，{k}{v}了{k}。", "{Z}，长度为{n}的{k}{z}{v}了{k}。", "计算得到{n} * {n} = {n}。", "{k}里有{n}个{k}，丢弃{n}个，还剩多少个?", "每个{k}有{n}行，一共有{n}个{k}，总共有多少行?", "答案是{n}。", "最终结果：{n}。",
    "Die {G} und das {G} werden {w} verglichen.", "Das {G} mit {n} Einträgen {w} unter Last.", "Der {G} prüft in jedem Schritt, und die {G} bleibt gleich.", "Wenn die {G} fehlt, ersetzt der Aufruf sein Ziel.", "Für die Werte {n} und {n} ist das {G} genau.", "Ein {G} fällt von {n} um {n}. Welcher {G} bleibt?", "Aus {n} * {n} folgt der Wert {n}.", "In jedem von {n} {G} stehen {n} {G}.", "Somit sehen wir, dass der {G} zu groß ist.", "Außerdem gilt: die {G} ordnet nicht immer.", "Im Mittel ordnet das {G} bei kleinen Werten.", "Nach dem Lemma von {F} gilt dies.", "Warum ist die {G} hier wichtig, und was ergibt {n} mal {n}?", "Am Ende des Laufs stört der {G}.", "Die Antwort ist {n}.", "Eine {G} der {G} zeigt dies.",
    "Si le {w} manque, l'appel borne cet écart à la fin.", "Entre {n} et {n}, la {w} décale la {w}.", "Le {w} de taille {n} rejette la {w}.", "Chaque caisse contient {n} pièces et il y a {n} caisses.", "De plus, il suffit que la {w} soit {w}.", "On calcule {n} + {n} = {n}.", "Le lemme de {F} suffit.", "La rue est longue de {n} mètres.",
    "Si falta la {w}, la llamada corrige ese {w}.", "Entre {n} y {n}, el {w} limita el valor.", "La {w} de tamaño {n} reduce la suma.", "Cada caja guarda {n} piezas y hay {n} cajas.", "De {n} fichas se retiran {n}.", "El lema de {F} basta.", "Por tanto, vemos que la {w} explica la suma.", "Primero, la {w} cuenta.",
    "从第{n}步到第{n}步，{c}{c}拒绝了{c}{c}。", "如果没有{c}{c}，{c}{c}就限制了{c}{c}。", "{c}{c}与{c}{c}在窗口之外进行了比较。", "总之可以看到，{c}{c}统计了{n}个{c}{c}。", "显然，长度为{n}的{c}{c}在第二次实验中覆盖了{c}{c}。", "求{n}与{n}的和。", "首先，{c}{c}负载较高时检查了{c}{c}。", "由{n} + {n}可得{n}。", "然而,{c}{c}每一步重排了{c}{c}。", "平均而言，{c}{c}修正了{c}{c}。", "由{c}{c}{w}，{c}{c}缩短了{c}{c}。", "根据报告，{c}{c}拆分了{c}{c}，而{c}{c}保持不变。", "请说明{c}{c}为什么重要，并计算{n}加{n}。",
]
STARTERS = "The A An Here After If What Between Our This Neither Does Under In For By From As Phone Call Write Interestingly Meanwhile Compared Oddly Put See How Combining So We Find When It There No Each Every Strictly Suppose Let Complete Report Bind Ship Use On At".split()
GERMAN = "Der Die Das Ein Eine Zunächst Trotzdem Deshalb Offenbar Leider Danach Wenn Im Am Für Wie Aus Somit Außerdem Telefon Rückruf Anschrift Lieferung Dann Daher".split()
ROMANCE = "Donc Ensuite Hélas Enfin Selon Si Le La Les En Entre De Chaque Comme El Los Así Además Después Primero Por Como Sin Tel Appelez Livraison Pièce Documento Entrega".split()
WIDE_STARTERS = "首先 随后 另外 总之 显然 因此 然而 平均而言 换句话说 不出所料 此外 其次 最后 例如 于是 同时 如上 可见".split()
WIDE_WHEN = "训练结束时 预热之后 对于较小的数值 在大多数情况下 重试之后 负载较高时 每一步 在窗口之外 根据报告 批次为奇数时 在第二次实验中 通常 有时 稍后 在开始时 缓慢地 经常 立即".split()
WIDE_NOUNS = "掩码 模型 窗口 缓存 循环 样本 矩阵 梯度 日志 序列 损失 阈值 批次 词表 索引 分支 余数 上界 采样器 验证器 检查点 注册表 奖励函数 提示词 数据 文件 参数 节点 队列 任务 结果 步骤 分片 字段 目录".split()
WIDE_VERBS = "拒绝 限制 统计 覆盖 重排 检查 修正 拆分 隐藏 加倍 稳定 移动 缩短 替换 解释 更新 读取 合并 删除 比较 记录 复制".split()
COMMON = "batch window cache model buffer ledger kernel sampler parser index vector matrix policy reward shard tensor module dataset prompt token metric loader worker queue schema update replaces reports filters stores merges splits tracks narrow hidden sparse frozen local global stable".split()
NOUNS = "Matrix Folge Maske Schwelle Register Protokoll Zähler Prüfer Puffer Gradient Modell Gitter Verzeichnis Ablauf Rest Belohnung Stichprobe Zerlegung Näherung Intervall Speicher Regal Band Werte".split()
STREETS = ["Street", "Road", "Avenue", "Lane", "Drive", "Close", "St.", "Rd.", "Ave.", "Court", "Way", "Place", "Square", "Terrace", "Hill", "Crescent"]
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvwz"
WIDE = [chr(c) for c in range(0x4E00, 0x9F00, 7)]
WIDE_COMMON = list("掩码模型窗口缓存循环样本矩阵梯度日志序列损失阈值批次词表索引分支余数上界采样器验证检查点注册表奖励函数提示")


#: Chinese family names of two characters, and words within a name that begin small.
COMPOUND = {"欧阳", "司马", "上官", "诸葛", "司徒", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "长孙", "宇文", "夏侯"}
PARTICLES = ["de", "de la", "del", "de los", "von", "van", "van der", "van den", "di", "da", "dos", "du", "zu", "bin", "al", "el", "ter", "ten"]


class _Draws(random.Random):
    """Python's generator with numpy's name for whole numbers: single draws are much quicker."""

    def integers(self, low: int, high: int | None = None) -> int:
        low, high = (0, low) if high is None else (low, high)
        return low + int(self.random() * (high - low))


class _Filler:
    def __init__(self, seed: int) -> None:
        self.rng = _Draws(seed)

    def pick(self, seq):  # noqa: ANN001, ANN201
        return seq[self.rng.integers(len(seq))]

    def syllables(self, n: int) -> str:
        return "".join(self.pick(CONSONANTS) + self.pick(VOWELS) + (self.pick("nrlsdk") if self.rng.random() < 0.35 else "") for _ in range(n))

    def proper(self, n: int = 0) -> str:
        word = self.syllables(n or int(self.rng.integers(1, 4)) + 1).title()
        if self.rng.random() < 0.06:
            word = word.replace("a", "á", 1).replace("e", "é", 1)
        return word

    def digits(self, n: int) -> str:
        return "".join(str(self.rng.integers(10)) for _ in range(n))

    def case(self, s: str) -> str:
        return s.upper() if self.rng.random() < 0.1 else s

    def E(self) -> str:  # noqa: N802
        a, b = self.syllables(2), self.syllables(int(self.rng.integers(2, 4)))
        local = a + self.pick([".", "_", "", "-"]) + b if self.rng.random() < 0.75 else a[0] + self.pick([".", ""]) + b
        local += self.pick(["", "", "+" + self.syllables(1), self.digits(2), self.digits(1)])
        host = self.syllables(2) + self.pick(["", "", "." + self.syllables(2)]) + "." + self.pick(["example", "com", "org", "net", "test", "invalid", "de", "fr"])
        at = self.pick(["@", "@", "@", "@", "@", "(at)", " [at] ", " @ ", "[at]", " (at) ", " at "])
        if at in (" [at] ", "[at]", " (at) ", " at "):
            host = host.replace(".", {" [at] ": " [dot] ", "[at]": "[dot]", " (at) ": " (dot) ", " at ": " dot "}[at])
        return self.case(local + at + host)

    def P(self) -> str:  # noqa: N802
        d = self.digits
        return self.pick([f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(4)} {d(6)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(2)} {d(5)} {d(3)}", f"+{d(1)} {d(3)} {d(7)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(4)}", f"+{d(2)}{d(10)}", f"({d(3)}){d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(8)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"1{d(10)}", f"+{d(2)} 1{d(2)} {d(4)} {d(4)}"])

    def I(self) -> str:  # noqa: E743, N802
        d, u = self.digits, lambda: self.pick("ABCDEFGHJKLMNPQRSTVWXYZ")
        return self.pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{u()}{u()}{d(6)}{u()}", f"{u()}{u()} {d(2)} {d(2)} {d(2)} {u()}", d(18), d(17) + "X", f"{d(8)}{u()}", f"{u()}{d(8)}", f"{u()}{u()}{d(7)}", f"{u()}{d(7)}", d(18), f"{d(8)}-{u()}", f"{u()}{d(2)}{u()}{d(5)}"])

    def A(self) -> str:  # noqa: N802
        n = str(self.rng.integers(1, 400)) + self.pick(["", "", "", "", "", "a"])
        names = " ".join(self.proper(2) for _ in range(self.pick([1, 1, 2])))
        low = self.syllables(2)
        kind = self.rng.integers(10)
        if kind < 4:
            return f"{n} {names} {self.pick(STREETS)}"
        if kind == 4:
            return f"{self.proper(2)}{self.pick(['straße', 'strasse', 'weg', 'gasse', 'allee', 'platz'])} {n}"
        if kind == 5:
            return f"{self.pick(['Am', 'An der', 'Im', 'Zum'])} {self.proper(3)} {n}"
        if kind == 6:
            return f"{n}{self.pick(['', '', ','])} {self.pick(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'impasse', 'quai', 'allée'])} {self.pick(['des', 'de la', 'du', 'de'])} {self.proper(2)}{self.pick(['', '-' + self.proper(2), ' ' + self.proper(2)])}"
        if kind == 7:
            return f"{self.pick(['Calle', 'Plaza', 'Avenida', 'Paseo', 'Camino', 'Ronda'])} {self.pick(['del', 'de la', 'de'])} {self.proper(2)}{self.pick(['', ' ' + self.proper(2)])}{self.pick([' ', ' ', ', '])}{n}"
        if low and kind == 8:
            return "".join(self.pick(WIDE) for _ in range(self.pick([2, 3, 4]))) + self.pick("路街巷道") + str(self.rng.integers(1, 400)) + "号"
        return "".join(self.pick(WIDE) for _ in range(self.pick([2, 3]))) + self.pick(["路", "街", "南街", "北路", "大道", "巷"]) + str(self.rng.integers(1, 400)) + "号"

    def N(self, wide: bool = False) -> str:  # noqa: N802
        if wide and self.rng.random() < 0.8:
            if self.rng.random() < 0.08:
                return self.pick(sorted(COMPOUND)) + "".join(self.pick(WIDE) for _ in range(self.pick([1, 2, 2])))
            return "".join(self.pick(WIDE) for _ in range(self.pick([2, 3, 3, 3, 3, 3, 3, 3])))
        given, family = self.proper(), self.proper(3)
        rare = self.rng.random()
        if rare < 0.08:
            return f"{given}-{self.proper()} {family}"
        if rare < 0.11:
            return f"{given} {family}-{self.proper(2)}"
        if rare < 0.24:
            return f"{given}{self.pick(['', ' ' + self.proper()])} {self.pick(PARTICLES)} {family}"
        kind = self.rng.integers(8)
        if kind in (0, 2):
            return f"{family}, {given}"
        if kind == 1:
            return f"{given} {self.pick('ABCDEFGHJKLMNPRST')}. {family}"
        return self.case(f"{given} {family}")


def _sentence(f: _Filler) -> list[tuple[str, int]]:
    """Parts of one line with the kind of each (0: none)."""
    marked = f.rng.random() < 0.55
    text = f.pick(MARKED if marked else PLAIN)
    wide = any(ord(c) > 0x2E80 for c in text)
    parts: list[tuple[str, int]] = []
    for piece in re.split(r"(\{[EPIANnwWFHGLdcSDQZzkv]\})", text):
        if not re.fullmatch(r"\{[EPIANnwWFHGLdcSDQZzkv]\}", piece):
            parts.append((piece, 0))
            continue
        c = piece[1]
        if c in "EPIAN":
            value = f.N(wide or ("name" in text or "author" in text) and f.rng.random() < 0.3) if c == "N" else getattr(f, c)()
            while c == "A" and wide and ord(value[0]) < 0x2E80 and f.rng.random() < 0.8:
                value = f.A()
            parts.append((value, 1 + "EPIAN".index(c)))
        else:
            made = {"n": lambda: str(f.rng.integers(1, 10 ** f.rng.integers(1, 5))), "w": lambda: f.pick(COMMON) if f.rng.random() < 0.5 else f.syllables(int(f.rng.integers(1, 4))), "W": f.proper, "F": lambda: f.proper(3), "H": lambda: "".join(f.pick("0123456789abcdef") for _ in range(12)), "G": lambda: f.pick(NOUNS) if f.rng.random() < 0.7 else f.proper(), "L": lambda: f.digits(int(f.rng.integers(5, 10))), "d": lambda: f.digits(1), "c": lambda: f.pick(WIDE_COMMON) if f.rng.random() < 0.8 else f.pick(WIDE), "S": lambda: f.pick(STARTERS), "D": lambda: f.pick(GERMAN), "Q": lambda: f.pick(ROMANCE), "Z": lambda: f.pick(WIDE_STARTERS), "z": lambda: f.pick(WIDE_WHEN), "k": lambda: f.pick(WIDE_NOUNS) if f.rng.random() < 0.85 else f.pick(WIDE) + f.pick(WIDE), "v": lambda: f.pick(WIDE_VERBS)}
            parts.append((made[c](), 0))
    return parts


def labelled_table(seed: int = 5, n: int = TABLE_SENTENCES) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Lines of one to three sentences, and the spans (start, end, kind from 1) in each."""
    f = _Filler(seed)
    lines, spans = [], []
    while len(lines) < n // 2:
        text, marks = "", []
        for k in range(f.pick([1, 2, 2, 3])):
            parts = _sentence(f)
            if k and not (ord(text[-1]) > 0x2E80 or ord("".join(p for p, _ in parts)[0]) > 0x2E80 or f.rng.random() < 0.1):
                text += " "
            for piece, kind in parts:
                if kind:
                    marks.append((len(text), len(text) + len(piece), kind))
                text += piece
        lines.append(text)
        spans.append(marks)
    return lines, spans


# ------------------------------------------------------------------------------------------------------- features
L_SPACE, L_WORD, L_DIGIT, L_WIDE, L_PUNCT = range(5)


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    lengths: np.ndarray  # tokens of each line that has any
    doc: np.ndarray
    points: np.ndarray
    begins: np.ndarray


def tokens(texts: list[str]) -> Tokens:
    """Runs of letters, runs of digits, single ideographs and single marks; a line feed ends a line."""
    points, begins = W.join_points(texts)
    base = W.classes(points)
    blank = np.isin(points, np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x3000, 0x2028, 0x200B], np.uint32))
    kind = np.select([blank, base == W.WORD, base == W.DIGIT, base == W.WIDE], [L_SPACE, L_WORD, L_DIGIT, L_WIDE], L_PUNCT).astype(np.uint8)
    before = np.concatenate(([L_SPACE], kind[:-1])).astype(np.uint8)
    starts = (kind != L_SPACE) & ((kind != before) | (kind >= L_WIDE))
    s = np.flatnonzero(starts)
    after = np.concatenate((kind[1:], [L_SPACE]))
    ends = (kind != L_SPACE) & ((kind != after) | (kind >= L_WIDE))
    e = np.flatnonzero(ends) + 1
    line = np.concatenate(([0], np.cumsum(points == 10)))[s] if len(s) else np.zeros(0, np.int64)
    doc = np.searchsorted(begins, s, "right") - 1
    edge = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(s) else np.zeros(0, np.int64)
    return Tokens(s, e, kind[s], np.diff(np.concatenate((edge, [len(s)]))), doc, points, begins)


SHAPES = 512
BUCKETS = 1 << 14


@dataclass
class Lexicon:
    """Words and endings that the labelled table knows, as sorted hashes."""

    words: np.ndarray
    tails: np.ndarray

    def find(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return np.where(table[at] == h, at + 1, 0)


def _hashes(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Case-blind hash of each token and of its last three characters."""
    low = t.points.astype(np.uint64)
    upper = (t.points >= 65) & (t.points <= 90) | (t.points >= 0xC0) & (t.points <= 0xDE)
    low = np.where(upper, low + np.uint64(32), low) + np.uint64(1)
    up, down = W.powers(len(low) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * up[:-1])))
        tail = np.maximum(t.start, t.end - 3)
        return W.mix((total[t.end] - total[t.start]) * down[t.start]), W.mix((total[t.end] - total[tail]) * down[tail] + np.uint64(9))


def features(t: Tokens, lexicon: Lexicon) -> np.ndarray:
    """Feature values of each token, each with its table's place added."""
    n = len(t.start)
    size = np.minimum(t.end - t.start, 20)
    p = t.points
    head = p[t.start]
    is_upper = ((p >= 65) & (p <= 90)) | ((p >= 0xC0) & (p <= 0xDE))
    uppers = np.concatenate(([0], np.cumsum(is_upper)))
    capitals = uppers[t.end] - uppers[t.start]
    form = np.select([capitals == 0, (capitals == 1) & is_upper[t.start], capitals == t.end - t.start], [0, 1, 2], 3)
    bucket = np.digitize(size, [2, 3, 5, 8])
    shape = np.select([t.kind == L_WORD, t.kind == L_DIGIT, t.kind == L_WIDE], [form * 5 + bucket, 20 + size, 45], 50 + (head * 31) % 400).astype(np.int64)
    gap = np.concatenate(([1], (t.start[1:] != t.end[:-1]).astype(np.int64)))
    new = np.zeros(n, bool)
    new[np.concatenate(([0], np.cumsum(t.lengths)))[:-1]] = True
    words, tails = _hashes(t)
    word, tail = lexicon.find(lexicon.words, words), lexicon.find(lexicon.tails, tails)
    line = np.cumsum(new)

    def moved(x: np.ndarray, by: int, blank: int) -> np.ndarray:
        out = np.full(n, blank, x.dtype)
        if by > 0:
            out[by:] = x[:-by]
            same = np.concatenate((np.full(by, -1), line[:-by])) == line if n > by else np.zeros(n, bool)
        else:
            out[:by] = x[-by:]
            same = np.concatenate((line[-by:], np.full(-by, -1))) == line if n > -by else np.zeros(n, bool)
        return np.where(same, out, blank)

    if n < 5:  # shifts below need room; a tiny batch is padded by the caller
        raise ValueError("at least five tokens")
    off = SHAPES - 1
    s1, s2, s_1, s_2 = moved(shape, 1, off), moved(shape, 2, off), moved(shape, -1, off), moved(shape, -2, off)
    s3, s_3 = moved(shape, 3, off), moved(shape, -3, off)
    g1 = np.where(new, 2, gap)
    g_1 = moved(g1, -1, 2)
    w1, w2, w_1, w_2 = moved(word, 1, 0), moved(word, 2, 0), moved(word, -1, 0), moved(word, -2, 0)
    v, u = len(lexicon.words) + 1, len(lexicon.tails) + 1
    hashed = lambda a, b, c=0: ((a * 7919 + b) * 104729 + c) % BUCKETS
    columns = [(shape * 3 + g1, SHAPES * 3), (s1 * 3 + g1, SHAPES * 3), (s_1 * 3 + g_1, SHAPES * 3), (s2, SHAPES), (s_2, SHAPES), (s3, SHAPES), (s_3, SHAPES), (word, v), (w1, v), (w_1, v), (w2, v), (w_2, v), (tail, u), (hashed(shape, s1, g1), BUCKETS), (hashed(shape, s_1, g_1), BUCKETS), (hashed(s1, s2, shape), BUCKETS), (hashed(s_1, s_2, shape), BUCKETS), (hashed(w1, shape, 1), BUCKETS), (hashed(w_1, shape, 2), BUCKETS)]
    out, base = np.empty((n, len(columns)), np.int32), 0
    for j, (x, width) in enumerate(columns):
        out[:, j] = x + base
        base += width
    return out


def _width(lexicon: Lexicon) -> int:
    v, u = len(lexicon.words) + 1, len(lexicon.tails) + 1
    return SHAPES * 9 + SHAPES * 4 + 5 * v + u + 6 * BUCKETS


@lru_cache(maxsize=1)
def model() -> tuple[crf.Chain, Lexicon]:
    """The field, trained on the labelled table; the same each time."""
    lines, spans = labelled_table()
    t = tokens(lines)
    words, tails = _hashes(t)
    known, counts = np.unique(words[t.kind != L_DIGIT], return_counts=True)
    endings, tail_counts = np.unique(tails[t.kind == L_WORD], return_counts=True)
    lexicon = Lexicon(known[counts >= 8], endings[tail_counts >= 8])
    gold = np.zeros(len(t.start), np.int64)
    for i, marks in enumerate(spans):
        for a, b, kind in marks:
            at = t.begins[i]
            inside = np.flatnonzero((t.start >= at + a) & (t.end <= at + b)) if b > a else []
            gold[inside] = 2 * kind
            if len(inside):
                gold[inside[0]] = 2 * kind - 1
    chain = crf.fit(features(t, lexicon), gold, t.lengths, _width(lexicon), LABELS)
    return chain, lexicon


# ----------------------------------------------------------------------------------------------------- spans
_EMAIL = re.compile(r"[\w.+-]+(?:\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)", re.I | re.A)
_PHONE = re.compile(r"[+(]?\d[\d ().-]{5,22}\d")
_ID = re.compile(r"[A-Z]{0,2} ?\d[A-Z\d -]{5,20}[A-Z\d]")
_WAYS = "Street|Road|Avenue|Lane|Drive|Close|Court|Way|Place|Square|Terrace|Hill|Crescent|Boulevard|Row|Walk|St\\.|Rd\\.|Ave\\.|Ln\\.|Dr\\.|Blvd\\."
_SHORT = re.compile(r"\b(?:St|Rd|Ave|Ln|Dr|Blvd|str)$", re.I)
_WAY = re.compile(rf"\b(?:{_WAYS})(?!\w)|(?:straße|strasse|gasse|platz)\b", re.I)
_STARTS = "|".join(ROMANCE)
_ADDRESS = [re.compile(p, re.I) for p in (
    rf"\b\d+[a-z]? (?:[^\W\d_][\w'’.-]* ){{1,3}}(?:(?:{_WAYS})(?!\w)|(?:St|Rd|Ave|Ln|Dr|Blvd)\b\.?)",
    r"\b[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)\s\d+[a-z]?\b",
    r"\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Bei der) [^\W\d_][\w-]*(?: [^\W\d_][\w-]*)? \d+[a-z]?\b",
    rf"\b\d+(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|square|passage)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?[^\W\d_][\w'’-]*(?: (?!(?:{_STARTS})\b)(?-i:[A-ZÀ-Þ])[\w'’-]*)*",
    r"\b(?:Calle|C/|Plaza|Avenida|Paseo|Camino|Ronda|Carrera|Travesía|Vía|Rambla)(?: (?:del|de la|de los|de las|de))?(?: [^\W\d_][\w'’-]*)+,? \d+[a-z]?\b",
    r"[\u3400-\u9fff]{1,6}[路街巷道弄里村]\d+[号號]",
)]
#: Characters that follow a person and that lead up to one.
FOLLOWS = set("说审的等先女同写提认")
LEADS = set("据由者名谢与和对请是为人向被让经给叫及")
_NAME = re.compile(r"[^\W\d_][\w'’-]*(?:,? (?:[A-Z]\. ?)*[^\W\d_][\w'’-]+)+|[\u3400-\u9fff]{2,4}", re.U)


#: A name with small words in it: given names, the small words, the family name.
_LONG_NAME = re.compile(r"[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)? (?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + r") [^\W\d_][\w'’-]+")
_SMALL = {w for x in PARTICLES for w in x.split()}
#: Words on either side of a span in which the rest of an address is looked for.
ADDRESS_WORDS = 4


def _word_before(text: str, at: int) -> int:
    """Where the word before a place begins, on the same line."""
    while at > 0 and text[at - 1] in " \t":
        at -= 1
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def _word_after(text: str, at: int) -> int:
    """Where the word after a place ends, on the same line."""
    while at < len(text) and text[at] in " \t":
        at += 1
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def settle(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact check: the span's edges by the form of its kind, or None where the form isn't there."""
    if kind == "email":
        while start > 0 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        line = text.find("\n", end)
        while m := _EMAIL.search(text, start, line if line >= 0 else len(text)):  # begins in the span, ends where its form does
            if m.start() >= end:
                return None
            if m.end() > start:
                return m.span()
            start = m.end()
        return None
    part = text[start:end]
    if kind == "phone":
        # only as far as the field's span and what belongs to the same run of digits
        while end < len(text) and (text[end].isdigit() or text[end] in "-." and text[end + 1 : end + 2].isdigit()):
            end += 1
        while start > 0 and (text[start - 1].isdigit() or text[start - 1] in "+(" or text[start - 1] in "-." and text[max(0, start - 2)].isdigit()):
            start -= 1
        m = _PHONE.search(text, start, end)
        return m.span() if m and 7 <= sum(c.isdigit() for c in m[0]) <= 15 else None
    if kind == "id_number":
        while end < len(text) and text[end].isascii() and text[end].isalnum():
            end += 1
        while start > 0 and text[start - 1].isascii() and text[start - 1].isalnum():
            start -= 1
        m = _ID.fullmatch(text[start:end].strip())
        if not m or sum(c.isdigit() for c in m[0]) < 6:
            return None
        lead = len(text[start:end]) - len(text[start:end].lstrip())
        return start + lead, start + lead + len(m[0])
    if kind == "address":
        while end < len(text) and (text[end].isalpha() or text[end] in "-'’" and text[end + 1 : end + 2].isalpha()):
            end += 1
        left, right = start, end  # as far as words of an address may go on either side, if the span itself has no form
        for _ in range(ADDRESS_WORDS):
            left = _word_before(text, left)
            right = _word_after(text, right)
        for a, b in ((start, end), (start, right), (left, right)):
            for form in _ADDRESS:
                for m in form.finditer(text[a:b]):
                    if a + m.start() < end and a + m.end() > start:
                        stop = a + m.end()
                        return a + m.start(), stop + (text[stop : stop + 1] == "." and bool(_SHORT.search(m[0])))
        return None
    if ord(part[0]) >= 0x2E80:
        if any(w.startswith(part[: len(w)]) for w in WIDE_STARTERS):
            return None  # a word that opens a sentence
        longest = 4 if part[:2] in COMPOUND else 3
        if len(part) > longest:
            end -= len(part) - longest
        led = start == 0 or ord(text[start - 1]) < 0x2E80 or text[start - 1] in LEADS or not text[start - 1].isalpha()
        if end - start == 2 and text[end : end + 1].isalpha() and text[end] not in FOLLOWS:
            led = False  # two characters at the head of a longer run are a word
        return (start, end) if led and _NAME.fullmatch(text[start:end]) else None
    part = re.sub(r"(?: [^\W\d_])+$", "", part)
    m = _LONG_NAME.match(part) or re.match(r"[^\W\d_][\w'’-]+(?:, [^\W\d_][\w'’-]+| (?:[A-Z]\. ?)*[^\W\d_][\w'’-]+)(?: [A-Z]\.(?=\s?[^\W\d_]))?", part)
    if not m:
        return None
    part, end = m[0], start + m.end()
    words = [w for w in re.findall(r"[^\W\d_][\w'’-]*", part) if w not in _SMALL]
    if not all(w[0].isupper() for w in words) or len(words) < 2:
        return None
    if part.isupper():  # inside a passage in capitals a run of capitals is no name
        around = re.findall(r"[^\W\d_]{2,}", text[max(0, start - 25) : start])[-1:] + re.findall(r"[^\W\d_]{2,}", text[end : end + 25])[:1]
        if any(w.isupper() for w in around if len(w) > 2):
            return None
    return start, end


def find_all(texts: list[str], field: tuple[crf.Chain, Lexicon] | None = None) -> list[list[tuple[int, int, str]]]:
    """For each text its details as (start, end, kind), in order of place. field: what model() gives, on a worker."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    chain, lexicon = field or model()
    t = tokens([*texts, "- - - - - -"])
    labels = crf.viterbi(chain, crf.scores(chain, features(t, lexicon)), t.lengths)
    first = np.zeros(len(labels), bool)
    first[np.concatenate(([0], np.cumsum(t.lengths)))[:-1]] = True
    kind = (labels.astype(np.int64) + 1) // 2
    before = np.concatenate(([0], kind[:-1]))
    opens = (kind > 0) & ((labels % 2 == 1) | (kind != before) | first)
    at = np.flatnonzero(opens)
    inside = kind > 0
    fresh = (labels % 2 == 1) | first
    done = 0
    for a in at:
        if a < done:
            continue
        b = a + 1
        while b < len(labels) and inside[b] and not opens[b]:
            b += 1
        i = int(t.doc[a])
        if i >= len(texts):
            continue
        base = int(t.begins[i])
        name = KINDS[kind[a] - 1]
        on = b
        while on < len(labels) and inside[on] and not fresh[on]:
            on += 1
        # small words are as common in streets: a span that goes on as another kind is a name if it has a name's form
        if on > b and {name, KINDS[kind[b] - 1]} == {"name", "address"} and _LONG_NAME.fullmatch(texts[i][int(t.start[a]) - base : int(t.end[on - 1]) - base]):
            name, b, done = "name", on, on
        start, end = int(t.start[a]) - base, int(t.end[b - 1]) - base
        if name == "name" and _WAY.search(texts[i][start:end]) and settle(texts[i], start, end, "address"):
            name = "address"  # a street is no person
        span = settle(texts[i], start, end, name)
        if span and (not found[i] or span[0] >= found[i][-1][1]):
            found[i].append((*span, name))
    return found


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder at each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


#: Texts are decoded in parts of about so many characters, to bound a worker's memory.
PART = 600_000


def _parts(batches: Iterator[pa.RecordBatch], field: Broadcast) -> Iterator[tuple[pa.Array, list[str | None], list[list[tuple[int, int, str]]]]]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= PART or i == len(texts) - 1:
                part = texts[at : i + 1]
                yield ids.slice(at, len(part)), part, find_all([x or "" for x in part], field.value)
                at, size = i + 1, 0


def find(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """The id, `kind` and `value`, once per text and value. Null, empty and blank texts have none."""
    field = df.sparkSession.sparkContext.broadcast(model())  # trained once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _parts(batches, field):
            rows = [(i, k, v) for i, t, spans in zip(ids.to_pylist(), texts, found) for k, v in dict.fromkeys((k, t[a:b]) for a, b, k in spans)]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], [id_column, "kind", "value"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, F.col(text).alias("_text")).mapInArrow(run, f"{id_column} {kind}, kind string, value string")


def redacted(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """The id and `text` with placeholders; null texts stay null."""
    field = df.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _parts(batches, field):
            out = [t if t is None else replaced(t, s) for t, s in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], [id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, F.col(text).alias("_text")).mapInArrow(run, f"{id_column} {kind}, text string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal details of every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal details replaced."""
    return redacted(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
