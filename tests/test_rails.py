"""Schema files, migrations and models of Active Record."""

import pytest
from building import build

from tessera.parsers import parse_file, rails

SCHEMA = '''# generated
ActiveRecord::Schema[7.1].define(version: 2024_01_01_000000) do
  enable_extension "plpgsql"
  create_enum "order_status", ["new", "paid"]

  create_table "users", id: :uuid, default: -> { "gen_random_uuid()" }, force: :cascade, comment: "people" do |t|
    t.string "email", limit: 120, null: false
    t.decimal "balance", precision: 10, scale: 2, default: "0.0"
    t.string "tags", default: [], array: true
    t.datetime "created_at", null: false
    t.index ["email"], name: "index_users_on_email", unique: true
    t.index "lower((email)::text)", name: "low"
  end

  create_table "orders", force: :cascade do |t|
    t.uuid "user_id", null: false
    t.enum "status", enum_type: "order_status", default: "new"
    t.references :owner, polymorphic: true
  end
  add_foreign_key "orders", "users", on_delete: :cascade
end
'''

MIGRATION = '''class CreateThings < ActiveRecord::Migration[7.0]
  def change
    create_table :things, id: false do |t|
      t.string :name, null: false, index: { unique: true }
      t.references :user, null: false, foreign_key: { to_table: :members, on_delete: :nullify }
      t.timestamps
    end
    create_join_table :users, :roles
    add_column :members, :age, :integer, default: 3 unless column_exists?(:members, :age)
    change_table :members do |t|
      t.remove :old
      t.string :nick
    end
    rename_column :members, :a, :b
    change_column_null :members, :b, false
    remove_column :members, :gone, :string
    drop_table :legacy
  end
  def down
    drop_table :things
  end
end
'''

MODEL = '''module Blog
  class Post < ApplicationRecord
    self.table_name = "blog_posts"
    belongs_to :author, class_name: "User", foreign_key: :writer_id, optional: true
    has_many :comments, dependent: :destroy
    has_many :readers, through: :reads
    has_one :cover
    has_and_belongs_to_many :tags
    enum :status, { draft: 0, live: 1 }
    scope :live, -> { where(live: true) }

    def x
      if a
        1
      end
    end
  end
end
class User < ApplicationRecord
end
class Admin < User
  has_many :logs
end
'''


def names(e):
    return [c.name for c in e.columns]


def test_schema():
    (p,) = [x for x in parse_file("db/schema.rb", SCHEMA) if x.kind == "rails"]
    users, orders = p.entities
    assert names(users) == ["id", "email", "balance", "tags", "created_at"] and users.comment == "people"
    id_, email, balance, tags, _ = users.columns
    assert (id_.type, id_.primary_key, email.type, email.nullable, balance.type, balance.default, tags.is_array) == ("uuid", True, "string(120)", False, "decimal(10,2)", "0.0", True)
    assert [(i.columns, i.unique) for i in users.indexes] == [(["email"], True)]
    assert names(orders) == ["id", "user_id", "status", "owner_id", "owner_type"] and orders.columns[0].type == "bigint"
    assert orders.columns[2].enum_ref == "order_status" and p.enums[0].values == ["new", "paid"] and p.engines[0].engine == "postgresql"
    (r,) = p.relations
    assert (r.from_.name, r.from_columns, r.to.name, r.on_delete) == ("orders", ["user_id"], "users", "CASCADE")


def test_migration():
    p = rails.parse("db/migrate/1_x.rb", MIGRATION)
    assert p.origin == "migration"
    things, joined, age, nick = p.entities
    assert names(things) == ["name", "user_id", "created_at", "updated_at"] and things.indexes[0].unique and not things.columns[2].nullable
    assert (joined.name, names(joined)) == ("roles_users", ["user_id", "role_id"]) and age.partial and age.columns[0].default == "3" and names(nick) == ["nick"]
    assert [(o.op, o.column or (o.table and o.table.name)) for o in p.ops] == [("dropColumn", "old"), ("renameColumn", "a"), ("alterColumn", "b"), ("dropColumn", "gone"), ("dropTable", "legacy")]
    assert (p.relations[0].to.name, p.relations[0].on_delete) == ("members", "SET NULL")


def test_models():
    p = rails.parse("app/models/post.rb", MODEL)
    assert [(e.name, e.model_name, e.name_certainty, e.shared_table) for e in p.entities] == [("blog_posts", "Post", 2, False), ("users", "User", 0, False), ("admins", "Admin", 0, True)]
    links = [(r.from_.model, r.to.model, r.from_columns, r.to_columns, r.cardinality) for r in p.relations]
    assert links == [
        ("Post", "User", ["writer_id"], [], "many-to-one"),
        ("Post", "Comment", [], ["post_id"], "one-to-many"),
        ("Cover", "Post", ["post_id"], [], "one-to-one"),
        ("Post", "Tag", [], [], "many-to-many"),
        ("Admin", "Log", [], ["admin_id"], "one-to-many"),
    ]
    assert p.enums[0].values == ["draft", "live"]


def test_a_schema_and_its_models_are_one_map():
    schema = build([rails.parse("db/schema.rb", SCHEMA), rails.parse("app/models/user.rb", "class User < ApplicationRecord\n  has_many :orders\nend\n")])
    assert {e["id"] for e in schema["entities"]} == {"users", "orders"}
    assert [(r["from"], r["to"]) for r in schema["relations"]] == [("orders", "users")]


@pytest.mark.parametrize("text", [SCHEMA, MIGRATION, MODEL, "end end", "class", "create_table do |", "%w[", ":"])
def test_half_typed_files(text):
    for n in range(0, len(text) + 1, 13):
        rails.parse("x.rb", text[:n])
    shape = lambda t: [(e.name, names(e), e.source.line) for e in rails.parse("x.rb", t).entities]
    assert shape(text) == shape(text.replace("\n", "\r\n"))
