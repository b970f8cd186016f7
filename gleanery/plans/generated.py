"""A corpus of sources that grows with the table `documents`: a file a row, by fixed templates, in one of three languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources.corpus import table

#: {0} is the row's id, {1} and {2} are its remainders by 7 and 5.
PYTHON = '''import json

class C{0}(Base):
    """Doc {0}."""

    def load(self, x):
        return helper{1}(x)

def main{2}():
    C{0}().load("y")
'''
GO = """package gen

type T{0} struct {{
	n int
}}

func (t *T{0}) Run(x int) int {{
	return helper{1}(x)
}}

func make{2}() *T{0} {{
	return &T{0}{{1}}
}}
"""
RUST = """pub struct S{0} {{ n: u32 }}
impl Turn for S{0} {{
    fn turn(&self) -> u32 {{
        helper{1}(self.n)
    }}
}}
const L{2}: u32 = 3;
"""
FILES = (("py", PYTHON), ("go", GO), ("rs", RUST))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, path, text) of each row of `documents`."""
    rows = table(spark, sf, "documents").select("doc_id")
    values = [F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 5).cast("string")]

    def filled(template: str):
        pieces, rest = [], template.replace("{{", "\x01").replace("}}", "\x02")
        while rest:
            text, _, rest = rest.partition("{")
            pieces.append(F.lit(text.replace("\x01", "{").replace("\x02", "}")))
            if rest:
                pieces.append(values[int(rest[0])])
                rest = rest[2:]
        return F.concat(*pieces)

    text = suffix = None
    for k, (name, template) in enumerate(FILES):
        here = F.col("doc_id") % len(FILES) == k
        text = F.when(here, filled(template)) if text is None else text.when(here, filled(template))
        suffix = F.when(here, F.lit(name)) if suffix is None else suffix.when(here, F.lit(name))
    return rows.select("doc_id", F.concat(F.lit("gen/f"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit("."), suffix).alias("path"), text.alias("text"))


# More languages, under each document's own lines as comments, so that places follow the text. {0} is the row's id.
TYPESCRIPT = """import { draw } from "./draw";
export interface Runner{0} {
  run(): void;
}
export enum Mode{0} { On, Off }
export type Result{0} = string | number;
export class Service{0} extends Base {
  constructor(private n: number) { super(); }
  async run(x: string): Promise<void> {
    if (x) { draw("}"); }
  }
}
export async function build{0}(x: number) {
  return new Service{0}(x);
}
export const NAME{0} = "{";
"""
JAVASCRIPT = """class Worker{0} {
  run(task) {
    return task; // }
  }
  static from(x) { return new Worker{0}(x); }
}
function helper{0}(a, b) {
  if (a) { return b; }
  return a;
}
exports.main{0} = helper{0};
"""
JAVA = """package org.made.p{0};

public interface Runner {
  void run(int n);
}
enum Mode { ON, OFF }
record Pair{0}(int a, int b) {}
public class Service{0} implements Runner {
  private final int n = 1;
  public Service{0}(int n) {
    this.n = n;
  }
  public void run(int n) {
    if (n > 0) { call(n); }
  }
}
"""
GO_GROUPS = """package work

const (
	First{0} = 1
	Second{0} = (2 + 3)
)

var Flag{0} = true

var (
	left{0} int
)

type Box{0} struct {
	n int
}

func (b *Box{0}) Open(x int) int {
	return x
}

func Make{0}() *Box{0} {
	return nil
}
"""
RUST_PARTS = """mod engine{0} {
}
pub enum Mode{0} {
    On,
}
pub trait Turn{0} {
    fn turn(&self) -> u32;
}
impl<T> Turn{0} for Box<T> where T: Core{0} {
    fn turn(&self) -> u32 {
        1
    }
}
type Text{0} = String;
pub async fn build{0}(n: u32) -> u32 {
    n
}
"""
CPP = """namespace made{0} {
class Gear{0} {
 public:
  explicit Gear{0}(int teeth);
  int turn(int by) const { return by; }
};
struct Config{0} {
  bool on;
};
enum class Mode{0} { On, Off };
int parse{0}(int x) {
  return x;
}
}
"""
CSHARP = """namespace Made.N{0};

public interface IRunner
{
    int Run(int n);
}
public enum Mode
{
    On,
    Off
}
public record Result{0}(int A);
public class Tool{0} : IRunner
{
    public string Name { get; set; }
    public event Action Changed;
    public Tool{0}(string name)
    {
        Name = name;
    }
    public int Run(int n)
    {
        return n;
    }
    public static int Build(int n) => n;
}
"""
PLAIN = """class NotCode{0} { }
"""
LANGUAGES = (("ts", TYPESCRIPT), ("js", JAVASCRIPT), ("java", JAVA), ("go", GO_GROUPS), ("rs", RUST_PARTS), ("cpp", CPP), ("cs", CSHARP), ("txt", PLAIN))


def many_languages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, path, text) of each row of `documents`: its lines as comments, then declarations in one of LANGUAGES."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    which, name = (F.col("doc_id") % len(LANGUAGES)).cast("int"), F.col("doc_id").cast("string")
    template = F.element_at(F.array(*(F.lit(t) for _, t in LANGUAGES)), which + 1)
    suffix = F.element_at(F.array(*(F.lit(s) for s, _ in LANGUAGES)), which + 1)
    comments = F.array_join(F.transform(F.coalesce(T.lines("text"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("// "), x, F.lit("\n"))), "")
    return rows.select("doc_id", F.concat(F.lit("many/f"), F.lpad(name, 7, "0"), F.lit("."), suffix).alias("path"), F.concat(comments, F.replace(template, F.lit("{0}"), name)).alias("text"))
