"""A small corpus of sources in all languages, for outline and reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "app/store.py": '''import json
from app.base import Base, helper


class Store(Base):
    """Keeps rows."""

    def load(self, path: str, *, strict: bool = False) -> dict:
        if strict:
            def check(row):
                return helper(row)
            return {k: check(v) for k, v in json.loads(path).items()}
        return helper(path)

    async def save(self):
        self.load("x")


if True:
    def main():
        store = Store()
        store.load("y")
''',
    "app/broken.py": "def broken(:\n",
    "web/view.ts": '''export interface View {
  render(): void;
}
export class Panel implements View {
  constructor(private name: string) {}
  async render(): Promise<void> {
    if (this.name) { draw("}"); }
  }
}
export const DEFAULT = new Panel("x"); // new Panel
async function draw(text: string) { return text; }
''',
    "srv/Main.java": '''package org.sample.srv;

public class Main {
  private int n;
  public Main(int n) { this.n = n; }
  static int twice(int x) {
    return 2 * x;
  }
  abstract void later(String s);
}
record Pair(int a, int b) {}
''',
    "srv/main.go": '''package srv

type Server struct {
	port int
}

const (
	Alpha = 1
	Beta  = 2
)

func New(port int) *Server {
	return &Server{port}
}

func (s *Server) Run() error {
	return listen(s.port)
}
''',
    "lib/core.rs": '''pub struct Core { n: u32 }
pub trait Turn {
    fn turn(&self) -> u32;
}
impl Turn for Core {
    fn turn(&self) -> u32 {
        helper(self.n)
    }
}
const LIMIT: u32 = 3;
pub fn helper(n: u32) -> u32 { n }
''',
    "lib/core.hpp": '''namespace core {
class Gear {
 public:
  explicit Gear(int teeth);
  int turn(int by) const { return by; }
};
enum class Mode { On, Off };
}
''',
    "win/Tool.cs": '''namespace Win.Tools;

public class Tool
{
    public string Name { get; set; }
    public event Action Changed;
    public Tool(string name)
    {
        Name = name;
    }
    public async Task<int> RunAsync(int n)
    {
        return Build(n);
    }
    public static int Build(int n) => n;
}
''',
    "docs/notes.md": "# Notes\n\nStore and Panel.\n",
}


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FILES.items()), "path string, text string")
