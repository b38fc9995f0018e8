"""Schemas and migrations of Ecto."""

import pytest
from building import build

from tessera.parsers import ecto, parse_file

SCHEMA = '''
defmodule App.People.User do
  @moduledoc """
  A "quoted" word, and do.
  """
  use Ecto.Schema
  @primary_key {:id, :binary_id, autogenerate: true}
  @foreign_key_type :binary_id
  @schema_prefix "auth"

  schema "users" do
    field :email, :string, null: false
    field :role, Ecto.Enum, values: [:member, :admin]
    field :tags, {:array, :string}, default: []
    field :password, :string, virtual: true
    belongs_to :org, App.People.Org
    has_many :posts, App.Blog.Post
    has_one :profile, App.People.Profile
    many_to_many :teams, App.People.Team, join_through: "users_teams"
    timestamps()
  end

  def changeset(user, attrs) do
    if attrs do
      user
    end
  end
end
'''

MIGRATION = '''
defmodule App.Repo.Migrations.Init do
  use Ecto.Migration

  def change do
    create table(:users, primary_key: false, prefix: "auth") do
      add :id, :binary_id, primary_key: true
      add :email, :string, null: false, size: 80
      timestamps()
    end

    create table(:posts) do
      add :user_id, references(:users, on_delete: :delete_all, type: :binary_id), null: false
      add :views, :integer, default: 0
    end
    create index(:posts, [:user_id])
    create unique_index(:users, [:email], name: :by_email)
    alter table(:posts) do
      add :slug, :string
      modify :views, :bigint, null: false
      remove :gone
    end
    rename table(:posts), :slug, to: :permalink
    rename table(:a), to: table(:b)
    drop table(:legacy)
  end

  def down do
    drop table(:users)
  end
end
'''


def names(e):
    return [c.name for c in e.columns]


def test_schema():
    (p,) = [x for x in parse_file("lib/user.ex", SCHEMA) if x.kind == "ecto"]
    (user,) = p.entities
    assert (user.name, user.schema, user.model_name, user.source.line) == ("users", "auth", "User", 10)
    assert names(user) == ["id", "email", "role", "tags", "org_id", "inserted_at", "updated_at"]
    of = {c.name: c for c in user.columns}
    assert (of["id"].type, of["id"].primary_key, of["email"].nullable, of["tags"].is_array, of["org_id"].type) == ("binary_id", True, False, True, "binary_id")
    assert of["role"].enum_ref == "users_role" and p.enums[0].values == ["member", "admin"]
    assert [(r.from_.model, r.to.model, r.from_columns, r.to_columns, r.cardinality) for r in p.relations] == [
        ("User", "Org", ["org_id"], [], "many-to-one"),
        ("User", "Post", [], ["user_id"], "one-to-many"),
        ("Profile", "User", ["user_id"], [], "one-to-one"),
        ("User", "Team", [], [], "many-to-many"),
    ]
    assert p.relations[3].through.name == "users_teams"


def test_migration():
    p = ecto.parse("priv/repo/migrations/1.exs", MIGRATION)
    users, posts, by_user, by_email, slug = p.entities
    assert p.origin == "migration" and (users.schema, names(users)) == ("auth", ["id", "email", "inserted_at", "updated_at"]) and users.columns[1].type == "string(80)"
    assert names(posts) == ["id", "user_id", "views"] and posts.columns[2].default == "0" and by_user.indexes[0].columns == ["user_id"] and by_email.indexes[0].unique and names(slug) == ["slug"]
    (r,) = p.relations
    assert (r.from_columns, r.to.name, r.on_delete, r.optional) == (["user_id"], "users", "CASCADE", False)
    assert [(o.op, o.column or o.table.name, o.to) for o in p.ops] == [("alterColumn", "views", None), ("dropColumn", "gone", None), ("renameColumn", "slug", "permalink"), ("renameTable", "a", "b"), ("dropTable", "legacy", None)]
    assert p.ops[0].set == {"type": "bigint", "nullable": False}
    schema = build([p])
    assert ("posts", "auth.users") in {(r["from"], r["to"]) for r in schema["relations"]} or ("posts", "users") in {(r["from"], r["to"]) for r in schema["relations"]}


@pytest.mark.parametrize("text", [SCHEMA, MIGRATION, "use Ecto.Migration\ndef change do\n  create table(:x\n    add :y,\nend", "schema", "{:"])
def test_half_typed_files(text):
    for n in range(0, len(text) + 1, 11):
        ecto.parse("x.exs", text[:n])
    shape = lambda t: [(e.name, names(e), e.source.line) for e in ecto.parse("x.exs", t).entities]
    assert shape(text) == shape(text.replace("\n", "\r\n"))
