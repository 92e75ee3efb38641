"""State, effects and props from source, golden cases."""

from __future__ import annotations

from sieveworks.sources.hooks import Hooks
from sieveworks.sources.tokens import Source

SOURCE = """
export const Panel = ({ user, theme: t, size = 3, ...rest }) => {
  const [a, setA] = useState(0);
  const [b, setB] = React.useState<string>('');
  const [c] = useReducer(f, {});
  useEffect(() => { if (user) { setA(1); other.setB(2); } }, []);
  React.useEffect(function () { setB('x'); }, [a, c, outside, a.b]);
  useEffect(() => { const g = () => setA(2); });
  const [d, setD] = useOther();
  return <Box user={user} look={t} size={size + 1} x={a}><Inner user={user} /></Box>;
};
function Box({ user, look }) {
  setA(3);
  return <Inner user={user} look={look} />;
}
function Inner({ user }) { const x = { user: 1 }; return <p title={user.name}>{user}</p>; }
function helper({ user }) { const [z, setZ] = useState(0); }
"""


def test_hooks(spark):
    h = Hooks(Source(spark.createDataFrame([("a.tsx", SOURCE)], "path string, content string")))
    name = lambda r: r["component"].split("@")[0]
    assert {(name(r), r["line"]) for r in h.components.collect()} == {("Panel", 2), ("Box", 12), ("Inner", 16)}
    assert {(name(r), r["state"], r["setter"]) for r in h.states.collect()} == {("Panel", "a", "setA"), ("Panel", "b", "setB"), ("Panel", "c", None)}
    lines = {r["effect"]: r["line"] for r in h.effects.collect()}
    assert sorted(lines.values()) == [6, 7, 8]
    assert {(lines[r["effect"]], r["state"]) for r in h.sets().collect()} == {(6, "a"), (7, "b"), (8, "a")}
    assert {(lines[r["effect"]], r["state"]) for r in h.deps().collect()} == {(7, "a"), (7, "c")}
    assert {(name(r), r["prop"]) for r in h.props.collect()} == {("Panel", "user"), ("Panel", "t"), ("Panel", "size"), ("Box", "user"), ("Box", "look"), ("Inner", "user")}
    assert {(name(r), r["prop"], r["child"], r["as"]) for r in h.handed.collect()} == {("Panel", "user", "Box", "user"), ("Panel", "t", "Box", "look"), ("Panel", "user", "Inner", "user"), ("Box", "user", "Inner", "user"), ("Box", "look", "Inner", "look")}
    assert {(name(r), r["prop"]) for r in h.used().collect()} == {("Panel", "user"), ("Panel", "size"), ("Inner", "user")}
